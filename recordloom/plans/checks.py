"""Queries of the validation of a store, the plan of its repair, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import attachments as T
from recordloom.operators import integrity as I
from recordloom.operators import quality as Q
from recordloom.operators import validation as V
from recordloom.plans.records import _VIOLATIONS, TYPED, YEAR, _loose_calls, typed_calls
from recordloom.plans.registry import Registry
from recordloom.plans.whole import _COMPARED, _files
from recordloom.sources.tables import table

query = Registry()

_MARKERS = """(SELECT c_custkey AS store, c_mktsegment <> 'MACHINERY' AS present, CASE WHEN c_acctbal < 0 THEN '2' WHEN c_acctbal < 1000 THEN '' ELSE '1' END AS version,
  CASE WHEN c_nationkey < 5 THEN '2024-02-30T10:00:00Z' WHEN c_nationkey < 8 THEN '2024-01-05 10:00:00' WHEN c_nationkey < 10 THEN NULL WHEN c_nationkey < 15 THEN '2024-01-05T10:00:00.5+02:00' ELSE '2024-01-05T10:00:00Z' END AS created_at, CASE WHEN c_nationkey = 20 THEN '' ELSE c_name END AS created_by FROM customer)"""


def _markers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as stores whose marker files have all kinds of faults."""
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    created = F.when(n < 5, "2024-02-30T10:00:00Z").when(n < 8, "2024-01-05 10:00:00").when(n < 10, None).when(n < 15, "2024-01-05T10:00:00.5+02:00").otherwise("2024-01-05T10:00:00Z")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("store"), (F.col("c_mktsegment") != "MACHINERY").alias("present"), F.when(b < 0, "2").when(b < 1000, "").otherwise("1").alias("version"), created.alias("created_at"), F.when(n == 20, "").otherwise(F.col("c_name")).alias("created_by"),
    )


@query(f"""SELECT store, f[1] AS type, f[2] AS message FROM (SELECT store, unnest(CASE WHEN NOT present THEN [['missing_marker', 'Marker file is missing']] ELSE list_filter([
  CASE WHEN version = '' THEN ['invalid_format', 'Missing required field: version'] WHEN version <> '1' THEN ['unsupported_version', 'Unsupported structure version: ' || version] END,
  CASE WHEN created_at IS NULL THEN ['invalid_format', 'Missing required field: created_at'] WHEN created_at NOT LIKE '____-__-__T%' OR TRY_CAST(created_at AS TIMESTAMPTZ) IS NULL THEN ['invalid_format', 'Invalid RFC3339 timestamp in created_at: ' || created_at] END,
  CASE WHEN created_by = '' THEN ['invalid_format', 'Missing required field: created_by'] END], lambda x: x IS NOT NULL) END) AS f FROM {_MARKERS})""")
def marker_check(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of the marker files of many stores."""
    return V.marker_report(_markers(spark, sf), "store").select("store", "type", "message")


_FILES_THERE = "(SELECT DISTINCT 'calls/' || file_name AS name FROM call_lines)"
_YEARS = f"(SELECT DISTINCT 'calls' AS kind, {YEAR} AS year FROM {TYPED} UNION SELECT DISTINCT 'sms', CAST(year(sent_at) AS INTEGER) FROM documents WHERE sent_at IS NOT NULL)"
_ABSENT = f"(SELECT 'structure' AS type, 'sms/' AS file WHERE EXISTS (SELECT 1 FROM documents WHERE sent_at IS NOT NULL) UNION ALL SELECT 'missing_file', 'calls/calls-' || year || '.xml' FROM {_YEARS} WHERE kind = 'calls' AND 'calls/calls-' || year || '.xml' NOT IN (SELECT name FROM {_FILES_THERE}))"


def _structure(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "call_lines").select(F.concat(F.lit("calls/"), "file_name").alias("name"))
    years = typed_calls(spark, sf).select(F.lit("calls").alias("kind"), S.utc_year("date").alias("year")).unionByName(table(spark, sf, "documents").where("sent_at is not null").select(F.lit("sms").alias("kind"), F.year("sent_at").alias("year")))
    return V.structure_report(files, years)


@query(f"SELECT type, file FROM {_ABSENT}")
def structure_check(spark: SparkSession, sf: str) -> DataFrame:
    """Missing folders and files of years: files are those that call lines come from, years those of all calls and documents."""
    return _structure(spark, sf).select("type", "file")


_COUNTS = """(SELECT file_name AS file, count(*) AS said, count(*) FILTER (contains(raw_line, 'date')) AS there FROM call_lines GROUP BY file_name)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "call_lines").groupBy(F.col("file_name").alias("file"))
    return V.count_report(lines.agg(F.count(F.lit(1)).alias("n")), table(spark, sf, "call_lines").where("contains(raw_line, 'date')").groupBy(F.col("file_name").alias("file")).agg(F.count(F.lit(1)).alias("n")))


@query(f"SELECT file, CAST(there AS VARCHAR) AS expected, CAST(said AS VARCHAR) AS actual FROM {_COUNTS} WHERE said <> there")
def count_check(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose declared count (all lines) isn't that of the lines that name a date."""
    return _counts(spark, sf).select("file", "expected", "actual")


_ORPHANS = "(SELECT h, h NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL) AS lonely FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL))"
_ALL = f"""(SELECT 'structure' AS stage, type, 'error' AS severity, file, CASE type WHEN 'structure' THEN 'Required sms directory not found' ELSE 'x' END AS message, NULL AS expected, NULL AS actual FROM {_ABSENT}
  UNION ALL SELECT 'manifest', state, CASE WHEN state IN ('missing_file', 'checksum_mismatch') THEN 'error' ELSE 'warning' END, name, 'x', NULL, NULL FROM {_COMPARED} WHERE state IS NOT NULL
  UNION ALL SELECT 'content', 'count_mismatch', 'error', file, 'x', CAST(there AS VARCHAR), CAST(said AS VARCHAR) FROM {_COUNTS} WHERE said <> there
  UNION ALL SELECT 'content', 'invalid_format', 'warning', 'call ' || call_id, violation, NULL, NULL FROM {_VIOLATIONS}
  UNION ALL SELECT 'consistency', 'orphaned_attachment', 'warning', h, 'x', NULL, NULL FROM {_ORPHANS} WHERE lonely)"""


def _texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Texts as attachments (hash, size) and the English ones as references."""
    d = table(spark, sf, "documents").where("text is not null").select("lang", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("size"))
    return d.groupBy("hash").agg(F.min("size").alias("size")), d.where("lang = 'en'").select("hash")


def _everything(spark: SparkSession, sf: str, version: str = "1") -> DataFrame:
    """The report of one store made of all tables."""
    marker = spark.createDataFrame([(True, version, "2024-01-01T00:00:00Z", "x")], "present boolean, version string, created_at string, created_by string")
    refused = Q.split_rows(_loose_calls(spark, sf), Q.call_violations())[1].select("call_id", F.explode("violations").alias("violation"))
    content = V.report(refused, "content", "invalid_format", "warning", F.concat(F.lit("call "), F.col("call_id").cast("string")), F.col("violation"))
    states = T.reference_check(*_texts(spark, sf)).where("state = 'orphaned'")
    consistency = V.report(states, "consistency", "orphaned_attachment", "warning", F.col("hash"), "Nobody refers to the attachment")
    return V.full_report(V.marker_report(marker), _structure(spark, sf), V.manifest_report(I.compare_manifest(*_files(spark, sf))), _counts(spark, sf), content, consistency)


@query(f"SELECT stage, type, severity, count(*) AS n FROM {_ALL} GROUP BY ALL")
def store_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of a whole store by stage, type and severity."""
    return _everything(spark, sf).groupBy("stage", "type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'known' AS version, CASE WHEN bool_or(severity = 'error') THEN 'invalid' ELSE 'valid' END AS status, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM {_ALL} UNION ALL SELECT 'unknown', 'invalid', 1, 0")
def store_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of the store, and of the same one under an unknown version, which is judged by its marker alone."""
    known = V.status(_everything(spark, sf)).withColumn("version", F.lit("known"))
    return known.unionByName(V.status(_everything(spark, sf, "7")).withColumn("version", F.lit("unknown"))).select("version", "status", "errors", "warnings")


@query(f"""SELECT type, file, CAST(CASE type WHEN 'structure' THEN 1 WHEN 'missing_file' THEN 2 WHEN 'count_mismatch' THEN 3 WHEN 'size_mismatch' THEN 3 END AS INTEGER) AS phase,
  CASE type WHEN 'structure' THEN 'Would create directory: sms' WHEN 'missing_file' THEN 'Would create file: ' || file WHEN 'count_mismatch' THEN 'Would update count attribute in ' || file || ' (from ' || actual || ' to ' || expected || ')' WHEN 'size_mismatch' THEN 'Would regenerate the manifest with correct file sizes' END AS details,
  CASE WHEN type IN ('structure', 'missing_file', 'count_mismatch', 'size_mismatch') THEN NULL WHEN type = 'checksum_mismatch' THEN 'Autofix preserves existing checksums to detect corruption' WHEN type = 'orphaned_attachment' THEN 'Use --remove-orphan-attachments flag' ELSE 'Not a safe autofix operation' END AS skip_reason FROM {_ALL}""")
def store_repair_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a repair would do about each violation, or why it leaves it."""
    return V.repair_plan(_everything(spark, sf)).select("type", "file", "phase", "details", "skip_reason")


@query(f"SELECT count(*) FILTER (type IN ('structure', 'missing_file', 'count_mismatch', 'size_mismatch')) AS fixed, count(*) FILTER (type NOT IN ('structure', 'missing_file', 'count_mismatch', 'size_mismatch')) AS skipped FROM {_ALL}")
def store_repair_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many violations a repair mends and leaves."""
    return V.repair_summary(V.repair_plan(_everything(spark, sf)))


@query("SELECT count(*) AS scanned, count(*) FILTER (lonely) AS orphans, coalesce(sum(size) FILTER (lonely), 0) AS bytes FROM (SELECT h, any_value(size) AS size, h NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL) AS lonely FROM (SELECT sha256(text) AS h, strlen(text) AS size FROM documents WHERE text IS NOT NULL) GROUP BY h)")
def orphan_removal_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Texts no English document holds as attachments nobody refers to: number and bytes."""
    return V.orphan_totals(*_texts(spark, sf))


@query("SELECT count(*) AS found, count(*) FILTER (source = 'sms' AND lang = 'en') AS migrated, count(*) FILTER (source = 'sms' AND (lang <> 'en' OR lang IS NULL)) AS failed, count(*) FILTER (source = 'mms') AS already, count(*) FILTER (source NOT IN ('sms', 'mms') OR source IS NULL) AS skipped FROM documents")
def migration_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a migration: short messages as files of the older layout, whole if English, picture messages as migrated ones."""
    layout = F.when(F.col("source") == "sms", "legacy").when(F.col("source") == "mms", "new")
    return V.migration_totals(table(spark, sf, "documents").select(F.col("doc_id").alias("hash"), layout.alias("layout"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("whole")))


_REFS = "(SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'attachments/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || sha256(coalesce(text, '')) WHEN n_chars % 4 = 1 THEN 'attachments/x' WHEN n_chars % 4 = 2 THEN 'other/' || sha256(coalesce(text, '')) ELSE 'attachments/' || coalesce(source, '') || '/0123456789' END AS path FROM documents)"


@query(f"SELECT path, f AS fault, count(*) AS n FROM (SELECT path, unnest(list_filter([CASE WHEN NOT starts_with(path, 'attachments/') THEN 'bad-prefix' END, CASE WHEN length(path) < 16 THEN 'too-short' END, CASE WHEN starts_with(path, 'attachments/') AND length(path) >= 16 AND NOT regexp_matches(path, '[0-9a-f]{{64}}') THEN 'no-hash' END], lambda x: x IS NOT NULL)) AS f FROM {_REFS}) GROUP BY ALL")
def reference_format_check(spark: SparkSession, sf: str) -> DataFrame:
    """References to attachments that aren't addresses."""
    h, m = F.sha2(F.coalesce("text", F.lit("")), 256), F.col("n_chars") % 4
    path = F.when(m == 0, S.path_of_hash(h)).when(m == 1, "attachments/x").when(m == 2, F.concat(F.lit("other/"), h)).otherwise(F.concat(F.lit("attachments/"), F.coalesce("source", F.lit("")), F.lit("/0123456789")))
    return V.attachment_path_faults(table(spark, sf, "documents").select(path.alias("path"))).groupBy("path", "fault").agg(F.count(F.lit(1)).alias("n"))


_ATTACHED = "(SELECT 'h' || p_partkey AS hash, p_size AS size, p_name AS file_name, CASE WHEN p_brand LIKE '%1' THEN 'image/png' WHEN p_brand LIKE '%2' THEN 'image/jpeg' END AS detected FROM part WHERE p_size < 45)"
_TOLD = "(SELECT 'h' || p_partkey AS hash, CASE WHEN p_size = 7 THEN 8 ELSE p_size END AS size, CASE WHEN p_size = 9 THEN NULL ELSE p_name END AS file_name, CASE WHEN p_size < 20 THEN 'IMAGE/PNG' ELSE 'image/jpeg' END AS mime FROM part WHERE p_size > 3)"


@query(f"""SELECT hash, unnest(list_filter([CASE WHEN t.hash IS NULL THEN 'missing-metadata' END, CASE WHEN a.hash IS NULL THEN 'no-attachment' END, CASE WHEN a.size <> t.size THEN 'size-mismatch' END, CASE WHEN a.hash IS NOT NULL AND t.hash IS NOT NULL AND a.file_name IS DISTINCT FROM t.file_name THEN 'name-mismatch' END,
  CASE WHEN detected <> lower(mime) THEN 'mime-mismatch' END], lambda x: x IS NOT NULL)) AS fault FROM {_ATTACHED} a FULL JOIN {_TOLD} t USING (hash)""")
def metadata_check(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions that don't agree with their attachments (parts as attachments, with differences by size)."""
    p, h = table(spark, sf, "part"), F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("hash")
    b, s = F.col("p_brand"), F.col("p_size")
    attached = p.where("p_size < 45").select(h, s.alias("size"), F.col("p_name").alias("file_name"), F.when(b.endswith("1"), "image/png").when(b.endswith("2"), "image/jpeg").alias("detected"))
    told = p.where("p_size > 3").select(h, F.when(s == 7, 8).otherwise(s).alias("size"), F.when(s != 9, F.col("p_name")).alias("file_name"), F.when(s < 20, "IMAGE/PNG").otherwise("image/jpeg").alias("mime"))
    return V.metadata_faults(attached, told)


@query("SELECT CAST(year(sent_at) AS INTEGER) AS year, CASE WHEN count(*) FILTER (text IS NULL) > 0 THEN 'error' WHEN coalesce(sum(n_chars), 0) = 0 THEN 'empty' ELSE 'ok' END AS health FROM documents GROUP BY 1")
def yearly_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of the documents of each year: lost texts are errors."""
    d = table(spark, sf, "documents").groupBy(F.year("sent_at").alias("year")).agg(F.count_if(F.col("text").isNull()).alias("errors"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n"))
    return d.select("year", V.health(F.col("errors"), F.col("n")).alias("health"))


@query("SELECT l_orderkey, l_linenumber, path FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'store/calls/' WHEN 'A' THEN 'x/sms/' ELSE 'in/' END || CASE l_linestatus WHEN 'O' THEN 'calls-' ELSE 'mms-' END || l_suppkey || CASE WHEN l_linenumber < 3 THEN '.XML' ELSE '.xml' END AS path FROM lineitem) WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber >= 3")
def input_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Input files by name, those of a store left out (lines of orders as paths)."""
    r = F.col("l_returnflag")
    path = F.concat(F.when(r == "R", "store/calls/").when(r == "A", "x/sms/").otherwise("in/"), F.when(F.col("l_linestatus") == "O", "calls-").otherwise("mms-"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") < 3, ".XML").otherwise(".xml"))
    return V.wanted_inputs(table(spark, sf, "lineitem").withColumn("path", path)).select("l_orderkey", "l_linenumber", "path")
