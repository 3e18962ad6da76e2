"""Consistency of a store: manifests, counts, years, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.quality import violations


def compare_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """name, state of files that differ: missing_file, extra_file, checksum_mismatch, size_mismatch. Both: name, size, checksum."""
    m, a = manifest.select("name", F.col("size").alias("m_size"), F.col("checksum").alias("m_sum")), actual.select("name", F.col("size").alias("a_size"), F.col("checksum").alias("a_sum"))
    state = (
        F.when(F.col("a_sum").isNull() & F.col("a_size").isNull(), "missing_file").when(F.col("m_sum").isNull() & F.col("m_size").isNull(), "extra_file")
        .when(~F.col("m_sum").eqNullSafe(F.col("a_sum")), "checksum_mismatch").when(~F.col("m_size").eqNullSafe(F.col("a_size")), "size_mismatch")
    )
    return m.join(a, "name", "full_outer").select("name", state.alias("state")).where("state is not null")


def compare_counts(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, expected, actual where they differ, either of them 0 if it has no row. Both: key, n."""
    both = expected.select(key, F.col("n").alias("expected")).join(actual.select(key, F.col("n").alias("actual")), key, "full_outer")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).where("expected <> actual")


def wrong_year(records: DataFrame, ms: str, year: str) -> DataFrame:
    """Rows whose UTC year isn't that of their file."""
    return records.where(F.year(F.timestamp_millis(ms)) != F.col(year))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """name, fault of entries: bad checksum form, size not positive, absolute or parent path, the manifest itself, named twice."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("size"))
    found = violations(
        (~F.coalesce(F.col("checksum").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)), "bad-checksum"), (F.coalesce("size", F.lit(0)) <= 0, "bad-size"),
        (F.col("name").startswith("/"), "absolute-path"), (F.col("name").contains(".."), "parent-path"), (F.col("name") == "files.yaml", "self-reference"), (F.col("nth") > 1, "duplicate-entry"),
    )
    return manifest.withColumn("nth", nth).select("name", F.explode(found).alias("fault"))


def files_to_skip(name: str = "name"):
    """Names a manifest leaves out: hidden ones (but the marker), temporary ones and those below ``rejected``."""
    c = F.col(name)
    hidden = c.rlike(r"(^|/)\.[^/]*") & ~c.rlike(r"^\.[a-z]+\.yaml$")
    return hidden | c.endswith(".tmp") | c.startswith("rejected/")
