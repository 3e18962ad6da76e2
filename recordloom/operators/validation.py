"""Validation of a whole store and the plan of its repair.

Every check gives rows of one report: stage, type, severity, file, message, expected,
actual. The stages run in the order marker, structure, manifest, content,
consistency; a store of an unknown version is judged by its marker alone.

Defined cases: a null expected or actual value is unknown and shown as null; an empty
report is valid and clean; repeated violations stay repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version of a store, and the form of its time of creation.
VERSION = "1"
RFC3339 = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
#: Violations that a repair may mend, by the phase in which it does, and reasons why it leaves others.
FIXES = {"structure": (1, "create_directory"), "missing_file": (2, "create_file"), "missing_marker": (2, "create_file"), "count_mismatch": (3, "update_xml_count"), "size_mismatch": (3, "update_file")}
SKIPPED = {"checksum_mismatch": "Autofix preserves existing checksums to detect corruption", "orphaned_attachment": "Use --remove-orphan-attachments flag"}
UNSAFE = "Not a safe autofix operation"
#: What the message of a missing directory says.
MISSING_DIRECTORY = ("directory not found", "missing directory", "directory does not exist", "required directory", "directory is missing")
STAGES = ("marker", "structure", "manifest", "content", "consistency")
_COLUMNS = ("stage", "type", "severity", "file", "message", "expected", "actual")


def is_rfc3339(text: Column) -> Column:
    """Is the text a time of RFC 3339 on a day that exists?"""
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return F.coalesce(text.rlike(RFC3339) & day.isNotNull(), F.lit(False))


def report(rows: DataFrame, stage: str, kind: Column | str, severity: Column | str, file: Column | str, message: Column | str, expected: Column | None = None, actual: Column | None = None, *keep: str) -> DataFrame:
    """Rows of a report; texts are literal values."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    values = (F.lit(stage), c(kind), c(severity), c(file), c(message), none if expected is None else expected.cast("string"), none if actual is None else actual.cast("string"))
    return rows.select(*keep, *[v.alias(n) for v, n in zip(values, _COLUMNS)])


def marker_report(markers: DataFrame, *keep: str) -> DataFrame:
    """Faults of marker files; ``markers``: present boolean, version, created_at, created_by (null and empty count as missing)."""
    empty = lambda n: F.coalesce(F.col(n) == "", F.lit(True))
    missing = lambda n: F.when(empty(n), F.struct(F.lit("invalid_format").alias("type"), F.lit(f"Missing required field: {n}").alias("message"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    fault = lambda kind, message, expected=None, actual=None: F.struct(F.lit(kind).alias("type"), message.alias("message"), (F.lit(None) if expected is None else F.lit(expected)).cast("string").alias("expected"), (F.lit(None) if actual is None else actual).cast("string").alias("actual"))
    found = F.filter(F.array(
        missing("version"), F.when(~empty("version") & (F.col("version") != VERSION), fault("unsupported_version", F.concat(F.lit("Unsupported structure version: "), "version"), VERSION, F.col("version"))),
        missing("created_at"), F.when(~empty("created_at") & ~is_rfc3339(F.col("created_at")), fault("invalid_format", F.concat(F.lit("Invalid RFC3339 timestamp in created_at: "), "created_at"))), missing("created_by"),
    ), lambda x: x.isNotNull())
    none = F.array(fault("missing_marker", F.lit("Marker file is missing"), "Marker file", F.lit("File not found")))
    rows = markers.select(*keep, F.explode(F.when(F.coalesce("present", F.lit(False)), found).otherwise(none)).alias("x"))
    return report(rows, "marker", F.col("x.type"), "error", ".marker.yaml", F.col("x.message"), F.col("x.expected"), F.col("x.actual"), *keep)


def structure_report(files: DataFrame, years: DataFrame) -> DataFrame:
    """Missing directories and files of years; ``files``: name (path within the store); ``years``: kind, year of the records there are."""
    named = files.select("name").distinct()
    folders = named.select(F.regexp_extract("name", "^([^/]+)/", 1).alias("kind")).distinct().withColumn("there", F.lit(True))
    kinds = years.select("kind").distinct().join(folders, "kind", "left")
    lost = report(kinds.where("there is null"), "structure", "structure", "error", F.concat("kind", F.lit("/")), F.concat(F.lit("Required "), "kind", F.lit(" directory not found")))
    expected = years.select("kind", "year").distinct().join(kinds.where("there"), "kind", "left_semi").withColumn("name", F.concat_ws("", "kind", F.lit("/"), "kind", F.lit("-"), F.col("year").cast("string"), F.lit(".xml")))
    absent = expected.join(named, "name", "left_anti")
    return lost.unionByName(report(absent, "structure", "missing_file", "error", F.col("name"), F.concat(F.lit("File of year "), F.col("year").cast("string"), F.lit(" not found"))))


def count_report(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Files whose declared number of records isn't the actual one. Both: file, n."""
    both = declared.select("file", F.col("n").alias("said")).join(actual.select("file", F.col("n").alias("there")), "file", "left").withColumn("there", F.coalesce("there", F.lit(0)))
    return report(both.where("said <> there"), "content", "count_mismatch", "error", F.col("file"), "Count attribute doesn't match the records", F.col("there"), F.col("said"))


def manifest_report(compared: DataFrame) -> DataFrame:
    """The rows of ``integrity.compare_manifest`` (name, state) as a report."""
    severity = F.when(F.col("state").isin("missing_file", "checksum_mismatch"), "error").otherwise("warning")
    return report(compared, "manifest", F.col("state"), severity, F.col("name"), F.replace("state", F.lit("_"), F.lit(" ")))


def attachment_path_faults(references: DataFrame) -> DataFrame:
    """path, fault of references that aren't addresses: not below ``attachments/``, fewer than 16 characters, or no hash in it."""
    p = F.coalesce("path", F.lit(""))
    found = F.filter(F.array(
        F.when(~p.startswith("attachments/"), F.lit("bad-prefix")), F.when(F.length(p) < 16, F.lit("too-short")), F.when(p.startswith("attachments/") & (F.length(p) >= 16) & ~p.rlike("/[0-9a-f]{64}(/|$)"), F.lit("no-hash")),
    ), lambda x: x.isNotNull())
    return references.select("path", F.explode(found).alias("fault"))


def metadata_faults(attachments: DataFrame, metadata: DataFrame) -> DataFrame:
    """hash, fault where the description of an attachment doesn't agree with it; attachments: hash, size, file_name, detected; metadata: hash, size, file_name, mime.

    ``missing-metadata``, ``size-mismatch``, ``name-mismatch``, ``mime-mismatch`` (only where the content shows its type), ``no-attachment``.
    """
    a = attachments.select("hash", F.col("size").alias("a_size"), F.col("file_name").alias("a_name"), F.col("detected"), F.lit(True).alias("stored"))
    m = metadata.select("hash", F.col("size").alias("m_size"), F.col("file_name").alias("m_name"), "mime", F.lit(True).alias("told"))
    both, there = a.join(m, "hash", "full_outer"), F.col("stored") & F.col("told")
    found = F.filter(F.array(
        F.when(F.col("told").isNull(), F.lit("missing-metadata")), F.when(F.col("stored").isNull(), F.lit("no-attachment")), F.when(there & ~F.col("a_size").eqNullSafe(F.col("m_size")), F.lit("size-mismatch")),
        F.when(there & ~F.col("a_name").eqNullSafe(F.col("m_name")), F.lit("name-mismatch")), F.when(there & F.col("detected").isNotNull() & (F.lower("mime") != F.col("detected")), F.lit("mime-mismatch")),
    ), lambda x: x.isNotNull())
    return both.select("hash", F.explode(found).alias("fault"))


def full_report(marker: DataFrame, *stages: DataFrame) -> DataFrame:
    """The rows of all stages; only those of the marker if it names an unknown version. One small aggregate of the marker decides."""
    unknown = marker.agg(F.coalesce(F.bool_or(F.col("type") == "unsupported_version"), F.lit(False)).alias("unknown"))
    rest = reduce(DataFrame.unionByName, stages)
    return marker.unionByName(rest.join(F.broadcast(unknown.where("not unknown").select(F.lit(1).alias("go"))), F.lit(1) == F.col("go")).drop("go"))  # one row


def status(rows: DataFrame, *by: str) -> DataFrame:
    """status (``invalid`` with an error, else ``valid``), errors, warnings, by columns."""
    errors, warnings = F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    out = rows.groupBy(*by).agg(errors, warnings) if by else rows.agg(errors, warnings)
    return out.withColumn("status", F.when(F.col("errors") > 0, "invalid").otherwise("valid"))


def ordered(rows: DataFrame) -> DataFrame:
    """A report in the order in which it is read: stage, errors first, type, file."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return rows.orderBy(rank, F.when(F.col("severity") == "error", 0).otherwise(1), "type", "file", "message")


def can_fix(kind: Column) -> Column:
    """May a repair mend a violation of this type?"""
    return F.coalesce(kind.isin(*FIXES), F.lit(False))


def is_missing_directory(message: Column) -> Column:
    """Does a message speak of a directory that isn't there?"""
    m = F.lower(message)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(m, F.lit(t)) for t in MISSING_DIRECTORY]), F.lit(False))


def repair_plan(rows: DataFrame, *keep: str) -> DataFrame:
    """phase, action, details, skip_reason of each row of a report (type, file, message, expected, actual): directories first, then files, then contents; what isn't safe is skipped."""
    kind, done = F.col("type"), can_fix(F.col("type")) & ((F.col("type") != "structure") | is_missing_directory(F.col("message")))
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in FIXES.items() for x in (k, v[i])])[kind]
    count = F.concat(F.lit("Would update count attribute in "), "file", F.when(F.col("expected").isNotNull() & F.col("actual").isNotNull(), F.concat(F.lit(" (from "), "actual", F.lit(" to "), "expected", F.lit(")"))).otherwise(""))
    details = (
        F.when(kind == "structure", F.concat(F.lit("Would create directory: "), F.rtrim("file", F.lit("/")))).when(kind.isin("missing_file", "missing_marker"), F.concat(F.lit("Would create file: "), "file"))
        .when(kind == "count_mismatch", count).when(kind == "size_mismatch", F.lit("Would regenerate the manifest with correct file sizes"))
    )
    reasons = F.create_map(*[F.lit(x) for kv in SKIPPED.items() for x in kv])
    return rows.select(*keep, "type", "file", F.when(done, pick(0)).alias("phase"), F.when(done, pick(1)).alias("action"), F.when(done, details).alias("details"), F.when(~done, F.coalesce(reasons[kind], F.lit(UNSAFE))).alias("skip_reason"))


def repair_summary(plan: DataFrame) -> DataFrame:
    """fixed, skipped of a plan."""
    return plan.agg(F.count("action").alias("fixed"), F.count("skip_reason").alias("skipped"))


def orphan_totals(attachments: DataFrame, references: DataFrame) -> DataFrame:
    """scanned, orphans, bytes: how many attachments (hash, size) nobody refers to (references: hash), and how much their removal frees."""
    marked = attachments.join(references.select("hash").distinct().withColumn("used", F.lit(True)), "hash", "left")
    lonely = F.col("used").isNull()
    return marked.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(lonely).alias("orphans"), F.coalesce(F.sum(F.when(lonely, F.col("size"))), F.lit(0)).alias("bytes"))


def migration_totals(files: DataFrame) -> DataFrame:
    """found, migrated, failed, already, skipped of attachments by hash; files: hash, layout (``legacy``, ``new``, else none), whole boolean.

    Legacy files whose content is whole migrate, those that aren't fail.
    """
    legacy = F.col("layout") == "legacy"
    return files.agg(
        F.count(F.lit(1)).alias("found"), F.count_if(legacy & F.col("whole")).alias("migrated"), F.count_if(legacy & ~F.coalesce("whole", F.lit(False))).alias("failed"),
        F.count_if(F.col("layout") == "new").alias("already"), F.count_if(~F.coalesce(F.col("layout").isin("legacy", "new"), F.lit(False))).alias("skipped"),
    )


def health(errors: Column, records: Column) -> Column:
    """``error``, ``empty`` or ``ok`` of a store by its errors and records."""
    return F.when(errors > 0, "error").when(records == 0, "empty").otherwise("ok")


def wanted_inputs(files: DataFrame, kind: str = "all") -> DataFrame:
    """Files to import by their ``path``: named ``calls*.xml`` or ``sms*.xml`` (``kind``: all, calls, sms), none that lie in a store already."""
    kinds = ("calls", "sms") if kind == "all" else (kind,)
    name = F.element_at(F.split("path", "/"), -1)
    starts = reduce(lambda a, b: a | b, [name.startswith(k) for k in kinds])
    return files.where(starts & name.endswith(".xml") & ~F.contains("path", F.lit("/calls/")) & ~F.contains("path", F.lit("/sms/")))
