"""Queries over whole tables for identity, attachments, reports, years, paths and graphs.

Where two overlapping inputs are needed, every row of the table is in one of them or in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import attachments as T
from recordloom.operators import coalesce as C
from recordloom.operators import contacts as K
from recordloom.operators import graphs as G
from recordloom.operators import integrity as I
from recordloom.operators import lineparse as L
from recordloom.operators import quality as Q
from recordloom.operators import textscan as X
from recordloom.plans.lines_sql import valid_lines
from recordloom.plans.registry import Registry
from recordloom.sources.tables import table

query = Registry()


_PICTURES = """(SELECT o_orderkey AS id, 'c' || o_custkey AS address, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS date, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS type, o_orderpriority AS m_id FROM orders)"""
_PART_TEXT = """string_agg('part' || i || '_seq:' || l_linenumber || '|part' || i || '_ct:' || l_returnflag || '|part' || i || '_name:' || l_partkey || '|part' || i || '_text:|' || CASE WHEN l_returnflag = 'R' THEN 'part' || i || '_path:p/' || l_suppkey || '|' ELSE 'part' || i || '_has_data:true|' END, '' ORDER BY i)"""


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
  p AS (SELECT l_orderkey, {_PART_TEXT} AS parts, string_agg('addr' || i || '_address:s' || l_suppkey || '|addr' || i || '_type:151|addr' || i || '_charset:106|', '' ORDER BY i) AS addrs FROM l GROUP BY l_orderkey)
  SELECT 'mms' AS kind, id, sha256('address:' || address || '|date:' || date || '|type:' || type || '|msgtype:mms|msg_box:' || type || '|m_id:' || m_id || '|m_type:132|' || coalesce(p.parts, '') || coalesce(p.addrs, '')) AS key,
    sha256('address:' || address || '|date:' || date || '|type:' || type || '|') AS short_key FROM {_PICTURES} LEFT JOIN p ON l_orderkey = id
  UNION ALL
  SELECT 'sms', doc_id, sha256('address:' || coalesce(address, '') || '|date:' || (epoch_us(sent_at) // 1000) || '|type:1|msgtype:sms|body:' || coalesce(text, '') || '|protocol:|subject:' || coalesce(lang, '') || '|service_center:|read:1|status:0|locked:0|date_sent:' || coalesce(epoch_us(stored_at) // 1000, 0) || '|'),
    sha256('address:' || coalesce(address, '') || '|date:' || (epoch_us(sent_at) // 1000) || '|type:1|') FROM documents WHERE source = 'sms' AND sent_at IS NOT NULL""")
def message_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Full and short key of picture messages (orders with their lines as parts and addresses) and of short messages."""
    line = F.struct(
        F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("order_a"), F.col("l_suppkey").alias("order_b"), F.col("l_returnflag").alias("ct"), F.col("l_partkey").cast("string").alias("name"), F.lit("").alias("text"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("p/"), F.col("l_suppkey").cast("string"))).alias("path"), F.when(F.col("l_returnflag") != "R", "x").alias("data"),
    )
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("parts"))
    nested = nested.withColumn("addrs", F.transform("parts", lambda p: F.struct(F.concat(F.lit("s"), p["order_b"].cast("string")).alias("address"), F.lit(151).alias("type"), F.lit(106).alias("charset"))))
    kind = F.when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    mms = table(spark, sf, "orders").select(
        F.lit("mms").alias("kind"), F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("address"), S.epoch_ms("o_orderdate").alias("date"),
        kind.alias("type"), kind.alias("msg_box"), F.col("o_orderpriority").alias("m_id"), F.lit(132).alias("m_type"),
    ).join(nested, "id", "left")
    sms = table(spark, sf, "documents").where("source = 'sms' and sent_at is not null").select(
        F.lit("sms").alias("kind"), F.col("doc_id").alias("id"), "address", S.epoch_ms("sent_at").alias("date"), F.lit(1).alias("type"), F.col("text").alias("body"), F.col("lang").alias("subject"), F.lit(1).alias("read"), S.epoch_ms("stored_at").alias("date_sent"),
    )
    both = mms.unionByName(sms, allowMissingColumns=True)
    return both.select("kind", "id", C.message_key(both).alias("key"), C.message_key(both, "short").alias("short_key"))


_EVENT_KEY = "sha256(concat_ws('|', user_id, event_type, epoch_us(ts)))"


@query(f"""WITH b AS (SELECT 0 AS src, * FROM events WHERE event_type <> 'error' OR value > 50 UNION ALL SELECT 1, * FROM events WHERE event_type <> 'view' OR value <= 50),
  r AS (SELECT *, row_number() OVER (PARTITION BY {_EVENT_KEY} ORDER BY src, event_id) AS rn FROM b)
  SELECT CAST(month(ts) AS INTEGER) AS month, event_type, count(*) FILTER (src = 0 AND rn = 1) AS initial, count(*) FILTER (src = 1 AND rn = 1) AS added, count(*) FILTER (src = 1 AND rn > 1) AS duplicates, count(*) FILTER (rn = 1) AS final, count(*) FILTER (src = 0) AS initial_rows FROM r GROUP BY ALL""")
def coalesce_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event log in two overlapping parts that hold every event, coalesced: counters by month and type."""
    e = table(spark, sf, "events")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")), 256)
    r = C.coalesce(e.where("event_type <> 'error' or value > 50"), e.where("event_type <> 'view' or value <= 50"), key, F.col("event_id"))
    return C.coalesce_statistics(r.withColumn("month", F.month("ts")), "month", "event_type")


#: Content types given to the parts in turn: binary ones, texts, with parameters and in other letters, and unknown ones.
_TYPES = ("image/jpeg", "IMAGE/TIFF", "video/quicktime", "audio/wav; rate=8", "application/octet-stream", "text/xml", "application/json", " text/rtf ", "application/smil", "x/unknown", "audio/aac", "image/svg+xml")
_TYPE = "(ARRAY[" + ", ".join(f"'{t}'" for t in _TYPES) + f"])[1 + length(coalesce(text, '')) % {len(_TYPES)}]"
_BINARY = r"^(image/(jpe?g|png|gif|bmp|webp|tiff?)|video/(mp4|3gpp|quicktime|avi|mov|wmv|flv)|audio/(mpeg|mp[34]|amr|wav|ogg|aac|m4a)|application/(pdf|zip|rar|7z|msword|octet-stream|vnd\.ms-(excel|powerpoint)|vnd\.openxmlformats-officedocument\.(wordprocessingml\.document|spreadsheetml\.sheet|presentationml\.presentation)))$"
_TEXTUAL = r"^(text/(plain|html|xml|css|javascript|csv|rtf|x-vcard|vcard)|application/(xml|json|javascript|smil|xhtml\+xml|vnd\.wap\.multipart\.related))$"
_ACTED = f"""(SELECT *, sha256(content) AS h, CASE WHEN content IS NULL THEN 'no-data' WHEN regexp_matches(t, '{_TEXTUAL}') THEN 'content-type-filtered' WHEN NOT regexp_matches(t, '{_BINARY}') THEN 'unknown-type' WHEN length(content) < 1024 THEN 'too-small' ELSE 'extracted' END AS a FROM (
  SELECT doc_id, {_TYPE} AS ct, lower(trim(string_split({_TYPE}, ';')[1])) AS t, CASE WHEN text <> '' AND (lang = 'en' OR source = 'report') THEN text END AS content FROM documents))"""
_STORED = "(SELECT sha256(text) AS h FROM documents WHERE source = 'manual')"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as parts: English ones hold their text as data, reports as the text of an attachment, the others nothing."""
    d = table(spark, sf, "documents")
    types = F.array(*map(F.lit, _TYPES))
    ct = F.element_at(types, F.length(F.coalesce("text", F.lit(""))) % len(_TYPES) + 1)
    return d.select("doc_id", ct.alias("ct"), F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("data"), "text", F.when(F.col("source") == "report", "attachment").alias("cd"))


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "documents").where("source = 'manual'").select(F.sha2("text", 256).alias("hash"))
    return T.extraction_actions(_parts(spark, sf), stored)


@query(f"SELECT doc_id, CASE WHEN a = 'extracted' AND h IN (SELECT h FROM {_STORED} WHERE h IS NOT NULL) THEN 'referenced' ELSE a END AS action, CASE WHEN a = 'extracted' THEN h END AS hash FROM {_ACTED}")
def part_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What is done with each part: extracted, referenced as it is stored already, or why it stays."""
    return _actions(spark, sf).select("doc_id", "action", "hash")


@query(f"""SELECT ct, count(*) FILTER (a = 'extracted' AND NOT s) AS extracted, count(*) FILTER (a = 'extracted' AND s) AS referenced, count(*) FILTER (a = 'content-type-filtered') AS content_type_filtered, count(*) FILTER (a = 'unknown-type') AS unknown_type,
  count(*) FILTER (a = 'no-data') AS no_data, count(*) FILTER (a = 'too-small') AS too_small FROM (SELECT *, coalesce(h IN (SELECT h FROM {_STORED} WHERE h IS NOT NULL), false) AS s FROM {_ACTED}) GROUP BY ct""")
def part_action_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Actions by content type."""
    return T.action_counts(_actions(spark, sf))


@query(f"""SELECT doc_id, coalesce(regexp_matches(t, '{_BINARY}'), false) AS is_binary, CASE WHEN t IN ('image/jpeg') THEN 'jpg' WHEN t IN ('image/tiff') THEN 'tiff' WHEN t = 'video/quicktime' THEN 'mov' WHEN t IN ('audio/wav', 'audio/aac') THEN substr(t, 7) ELSE 'bin' END AS extension FROM {_ACTED}""")
def part_extensions(spark: SparkSession, sf: str) -> DataFrame:
    """File extensions of content types."""
    kind = S.normalize_mime("ct")
    return _parts(spark, sf).select("doc_id", F.coalesce(kind.isin(*S.MIME_EXTENSIONS), F.lit(False)).alias("is_binary"), S.mime_extension("ct").alias("extension"))


@query("""WITH a AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND source <> 'sms'), r AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND (source IN ('sms', 'mms') OR lang = 'en'))
  SELECT coalesce(a.hash, r.hash) AS hash, CASE WHEN r.hash IS NULL THEN 'orphaned' ELSE 'missing' END AS state FROM a FULL JOIN r ON a.hash = r.hash WHERE a.hash IS NULL OR r.hash IS NULL""")
def attachment_states(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments (texts but short messages) without a reference, and references (messages and English texts) without an attachment."""
    d = table(spark, sf, "documents").where("text is not null").withColumn("hash", F.sha2("text", 256))
    return T.reference_check(d.where("source <> 'sms'"), d.where("source in ('sms', 'mms') or lang = 'en'"))


_MANIFEST = "(SELECT 'f' || o_orderkey AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS size, md5(o_orderstatus || o_orderpriority) AS checksum FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '5-LOW')"
_ACTUAL = "(SELECT 'f' || o_orderkey AS name, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS size, md5(CASE WHEN o_orderpriority LIKE '3%' THEN 'x' ELSE o_orderstatus || o_orderpriority END) AS checksum FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'P')"
_COMPARED = f"""(SELECT coalesce(m.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing_file' WHEN m.name IS NULL THEN 'extra_file' WHEN m.checksum <> a.checksum THEN 'checksum_mismatch' WHEN m.size <> a.size THEN 'size_mismatch' END AS state
  FROM {_MANIFEST} m FULL JOIN {_ACTUAL} a ON m.name = a.name)"""
_REPORT = f"(SELECT state AS type, CASE WHEN state IN ('missing_file','checksum_mismatch') THEN 'error' ELSE 'warning' END AS severity, name AS file, CAST(substr(name, 2) AS BIGINT) AS seq FROM {_COMPARED} WHERE state IS NOT NULL)"


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A manifest and the files it should list, made of ``orders`` with known differences; each order is in one of them at least."""
    o = table(spark, sf, "orders")
    name, size, text = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.round(F.col("o_totalprice") * 100).cast("bigint"), F.concat("o_orderstatus", "o_orderpriority")
    p = F.col("o_orderpriority")
    manifest = o.where("o_orderstatus <> 'P' or o_orderpriority = '5-LOW'").select(name, size.alias("size"), F.md5(text).alias("checksum"))
    actual = o.where("o_orderpriority <> '1-URGENT' or o_orderstatus = 'P'").select(name, (size + F.when(p.startswith("2"), 1).otherwise(0)).alias("size"), F.md5(F.when(p.startswith("3"), "x").otherwise(text)).alias("checksum"))
    return manifest, actual


def _report(spark: SparkSession, sf: str) -> DataFrame:
    r = I.compare_manifest(*_files(spark, sf))
    return r.select(F.col("state").alias("type"), F.when(F.col("state").isin("missing_file", "checksum_mismatch"), "error").otherwise("warning").alias("severity"), F.col("name").alias("file"), F.substring("name", 2, 20).cast("bigint").alias("seq"))


@query(f"SELECT name, state FROM {_COMPARED} WHERE state IS NOT NULL")
def manifest_states(spark: SparkSession, sf: str) -> DataFrame:
    """Files that differ from the manifest, and how."""
    return I.compare_manifest(*_files(spark, sf))


@query(f"SELECT type, severity, file, seq FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY seq) AS rn FROM {_REPORT} WHERE NOT contains(file, '9')) WHERE rn <= 5")
def report_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The first five violations of each type, files with a 9 left out (the filters of a report)."""
    return Q.filter_report(_report(spark, sf), excluded=("9",), per_type=5)


@query(f"SELECT type, severity, file, seq FROM {_REPORT} WHERE severity = 'error' AND type = 'missing_file'")
def report_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of one severity and type."""
    return Q.filter_report(_report(spark, sf), severities=("error",), types=("missing_file",))


@query(f"SELECT type, severity, count(*) AS n FROM {_REPORT} GROUP BY GROUPING SETS ((type), (severity), ())")
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by type, by severity and in all."""
    return Q.report_counts(_report(spark, sf))


@query(f"SELECT coalesce(NOT bool_or(severity = 'error'), true) AS valid, count(*) = 0 AS clean, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM {_REPORT}")
def report_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of the report."""
    return Q.report_status(_report(spark, sf))


@query(f"""SELECT file_name, count(*) AS calls, count(*) FILTER (year(make_timestamp(date * 1000)) <> CAST(regexp_extract(file_name, '([0-9]{{4}})', 1) AS INTEGER)) AS wrong_year, CAST(min(year(make_timestamp(date * 1000))) AS INTEGER) AS first_year, CAST(max(year(make_timestamp(date * 1000))) AS INTEGER) AS last_year
  FROM ({valid_lines()}) GROUP BY file_name""")
def file_year_check(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each file, those of another year than the file's name says, and the years they span; all valid lines, of both forms."""
    calls = L.valid_calls(table(spark, sf, "call_lines")).withColumn("file_year", F.regexp_extract("file_name", "([0-9]{4})", 1).cast("int"))
    year = S.utc_year("date")
    return calls.groupBy("file_name").agg(F.count(F.lit(1)).alias("calls"), F.count_if(year != F.col("file_year")).alias("wrong_year"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


_BARE = "regexp_replace(text, '[^()\\[\\]{}]', '', 'g')"
for _ in range(12):  # pairs vanish from the inside; no text nests deeper
    _BARE = f"regexp_replace({_BARE}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"


@query(f"SELECT doc_id, {_BARE} = '' AS balanced FROM documents WHERE text IS NOT NULL")
def bracket_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the brackets of each text open and close in order."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", X.balanced(F.col("text")).alias("balanced"))


@query(r"SELECT line_id, file_name GLOB '*.xml' AS xml, file_name GLOB 'calls-20??.*' AS yearly FROM call_lines")
def file_globs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of files by globs."""
    name = F.col("file_name")
    return table(spark, sf, "call_lines").select("line_id", name.rlike(X.glob_regex("*.xml")).alias("xml"), name.rlike(X.glob_regex("calls-20??.*")).alias("yearly"))


_PATH = """(SELECT p_partkey, (ARRAY['docs', 'src', '/etc', 'tests', 'src/..', 'lib/%2E%2e', 'a..b'])[1 + p_size % 7] || '/' || replace(p_name, ' ', '/') || (ARRAY['.md', '.py', '.yaml', '_test.go', '.bin', '', '.sh', '.toml'])[1 + p_partkey % 8] AS path FROM part)"""


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(path, '_test\\.[a-z]+') OR path LIKE 'tests/%' OR path LIKE '%/tests/%' OR path LIKE 'test/%' OR path LIKE '%/test/%' THEN 'test' WHEN path LIKE '%.md' OR path LIKE 'docs/%' OR path LIKE '%/docs/%' THEN 'docs'
  WHEN path LIKE '%.yaml' OR path LIKE '%.toml' THEN 'config' WHEN path LIKE '%.py' OR path LIKE '%.sh' THEN 'code' ELSE 'other' END AS category, NOT (path LIKE '/%' OR list_contains(string_split(replace(lower(path), '%2e', '.'), '/'), '..')) AS safe FROM {_PATH}""")
def path_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Category and safety of paths made of the names of parts."""
    folders, ends = ("docs", "src", "/etc", "tests", "src/..", "lib/%2E%2e", "a..b"), (".md", ".py", ".yaml", "_test.go", ".bin", "", ".sh", ".toml")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    path = F.concat(at(folders, F.col("p_size")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), at(ends, F.col("p_partkey")))
    p = table(spark, sf, "part").select("p_partkey", path.alias("path"))
    return p.select("p_partkey", X.file_category(F.col("path")).alias("category"), X.safe_path(F.col("path")).alias("safe"))


_STEPS = "(SELECT n_nationkey AS node, (n_nationkey * 7 + 3) % 25 AS next FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_name < 'J')"
_REACHED = f"WITH RECURSIVE w(node, reached) AS (SELECT node, next FROM {_STEPS} UNION SELECT w.node, e.next FROM w JOIN {_STEPS} e ON e.node = w.reached)"


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("n_nationkey"), table(spark, sf, "nation")
    return n.select(k.alias("node"), ((k * 7 + 3) % 25).alias("next")).unionByName(n.where("n_name < 'J'").select(k.alias("node"), F.col("n_regionkey").cast("bigint").alias("next")))


@query(f"{_REACHED} SELECT node FROM w WHERE node = reached")
def graph_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that reach themselves in a graph with several cycles."""
    return G.cycles(_steps(spark, sf)).select(F.col("node").cast("int").alias("node"))


@query(f"{_REACHED} SELECT node, reached FROM w")
def graph_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs that a path connects, in a graph with cycles."""
    return G.closure(_steps(spark, sf)).select(F.col("node").cast("int").alias("node"), F.col("reached").cast("int").alias("reached"))


@query(f"""WITH RECURSIVE d(node, here, n) AS (SELECT node, next, 1 FROM {_STEPS} UNION SELECT d.node, e.next, d.n + 1 FROM d JOIN {_STEPS} e ON e.node = d.here WHERE d.n < 26)
  SELECT node, CAST(min(n) AS INTEGER) AS steps FROM d WHERE node = here GROUP BY node""")
def graph_cycle_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the shortest chain that leads each node of a cycle back to itself."""
    chains = G.cycle_chains(_steps(spark, sf))
    return chains.select(F.col("node").cast("int").alias("node"), (F.size("chain") - 1).alias("steps"))


@query("""SELECT name, book, CASE WHEN book = 'filled' THEN 'error' ELSE 'warning' END AS severity FROM (SELECT DISTINCT contact_name AS name FROM calls UNION SELECT DISTINCT contact_name FROM imports) n, (VALUES ('filled'), ('empty')) b(book)
  WHERE name IS NOT NULL AND (book = 'empty' OR name NOT IN (SELECT name FROM contacts WHERE name IS NOT NULL))""")
def contact_references(spark: SparkSession, sf: str) -> DataFrame:
    """Names in calls and imports that no contact has: errors, or warnings where the address book is empty."""
    names = table(spark, sf, "calls").select(F.col("contact_name").alias("name")).union(table(spark, sf, "imports").select("contact_name"))
    c = table(spark, sf, "contacts")
    return K.unreferenced_names(names, c).withColumn("book", F.lit("filled")).unionByName(K.unreferenced_names(names, c.limit(0)).withColumn("book", F.lit("empty")))


@query("""SELECT doc_id, CASE source WHEN 'sms' THEN NULL WHEN 'report' THEN NULL ELSE strlen(text) END AS bytes, CASE source WHEN 'sms' THEN NULL WHEN 'report' THEN NULL ELSE sha256(text) END AS hash FROM documents WHERE text <> ''""")
def strict_base64(spark: SparkSession, sf: str) -> DataFrame:
    """Size and hash of decoded contents; of short messages the last sign is lost, reports hold a foreign sign, manual pages are broken into lines."""
    s = F.col("source")
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", "source", F.base64(F.encode("text", "utf-8")).alias("b"))
    lines = F.regexp_replace("b", "(.{76})", "$1\r\n")
    text = F.when(s == "sms", F.expr("substring(b, 1, length(b) - 1)")).when(s == "report", F.concat(F.lit("*"), F.expr("substring(b, 2)"))).when(s == "manual", lines).otherwise(F.col("b"))
    d = d.select("doc_id", text.alias("t"))
    data = S.decode_base64("t")
    return d.select("doc_id", F.octet_length(data).cast("bigint").alias("bytes"), F.sha2(data, 256).alias("hash"))
