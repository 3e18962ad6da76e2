"""Validation of rows: violations, good and refused rows, size limits, report filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bytes that a message may have.
MAX_MESSAGE_BYTES = 10 * 1024 * 1024


def violations(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the messages of the rules (condition, message) that hold; a null condition doesn't hold."""
    return F.filter(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in rules]), lambda x: x.isNotNull())


def call_violations() -> Column:
    """missing-timestamp, missing-number, invalid-type: N, negative-duration."""
    return violations(
        (F.coalesce("date", F.lit(0)) <= 0, "missing-timestamp"),
        (F.trim(F.coalesce("number", F.lit(""))) == "", "missing-number"),
        (~F.coalesce(F.col("type").isin(1, 2, 3, 4), F.lit(False)), F.concat(F.lit("invalid-type: "), F.coalesce(F.col("type").cast("string"), F.lit("0")))),
        (F.coalesce("duration", F.lit(0)) < 0, "negative-duration"),
    )


def message_violations() -> Column:
    """missing-timestamp (date 0), missing-address (empty, blanks count), invalid-type of a message of kind ``sms`` or ``mms``."""
    kind, t = F.col("kind"), F.col("type")
    return violations(
        (F.coalesce("date", F.lit(0)) == 0, "missing-timestamp"),
        (F.coalesce("address", F.lit("")) == "", "missing-address"),
        ((kind == "sms") & ~F.coalesce(t.isin(1, 2), F.lit(False)), "invalid-type"),
        ((kind == "mms") & ~F.coalesce(t.isin(1, 2), F.lit(False)), "invalid-msg-box"),
    )


def missing_part_types(parts: str = "parts") -> Column:
    """``part-i-missing-content-type`` for each part of an array that has no content type."""
    named = F.transform(parts, lambda p, i: F.when(F.coalesce(p["ct"], F.lit("")) == "", F.concat(F.lit("part-"), i.cast("string"), F.lit("-missing-content-type"))))
    return F.filter(named, lambda x: x.isNotNull())


def message_bytes(address: Column, body: Column) -> Column:
    """Bytes of a plain message with its envelope."""
    return F.octet_length(F.coalesce(address, F.lit(""))) + F.lit(50) + F.octet_length(F.coalesce(body, F.lit("")))


def parts_bytes(parts: str = "parts") -> Column:
    """Bytes of all parts of a message."""
    size = lambda p: sum((F.coalesce(F.octet_length(p[f]), F.lit(0)) for f in ("data", "ct", "name")), F.lit(0))
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + size(p))


def split_rows(rows: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, refused rows with ``violations``)."""
    checked = rows.withColumn("violations", found)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def violation_counts(refused: DataFrame) -> DataFrame:
    """violation, n."""
    return refused.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def filter_report(report: DataFrame, severities: tuple[str, ...] = (), types: tuple[str, ...] = (), excluded: tuple[str, ...] = (), per_type: int = 0) -> DataFrame:
    """A report (type, severity, file, message, seq) filtered by severity, type and parts of the file's name; at most ``per_type`` rows a type in order of seq."""
    if severities:
        report = report.where(F.col("severity").isin(*severities))
    if types:
        report = report.where(F.col("type").isin(*types))
    for part in excluded:
        report = report.where(~F.coalesce(F.contains("file", F.lit(part)), F.lit(False)))
    if per_type:
        report = report.withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy("seq"))).where(F.col("rn") <= per_type).drop("rn")
    return report


def report_counts(report: DataFrame) -> DataFrame:
    """type, severity, n by type, by severity and in all: one pass."""
    return report.groupingSets([["type"], ["severity"], []], "type", "severity").agg(F.count(F.lit(1)).alias("n"))


def report_status(report: DataFrame) -> DataFrame:
    """valid (no errors), clean (nothing at all), errors, warnings."""
    return report.agg(
        F.coalesce(~F.bool_or(F.col("severity") == "error"), F.lit(True)).alias("valid"), (F.count(F.lit(1)) == 0).alias("clean"),
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
