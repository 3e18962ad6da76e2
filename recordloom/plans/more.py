"""Further queries: logs, reports, rule tables, code blocks, snapshots, plans of repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators import stats as A
from recordloom.operators import textscan as X
from recordloom.operators.quality import violations
from recordloom.plans.registry import Registry
from recordloom.sources.tables import table

query = Registry()

_LOG = "(SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND source = 'importlog'), unnest(range(1, len(l) + 1)) AS u(i))"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return X.lines_of(table(spark, sf, "documents").where("source = 'importlog'"), "text", "doc_id")


@query(f"SELECT regexp_extract(line, '^[0-9-]+T[0-9:]+Z ([A-Z]+) ', 1) AS level, count(*) AS n FROM {_LOG} GROUP BY 1")
def log_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines by level."""
    return _log(spark, sf).groupBy(F.regexp_extract("line", "^[0-9-]+T[0-9:]+Z ([A-Z]+) ", 1).alias("level")).agg(F.count(F.lit(1)).alias("n"))


_ADDED = "'([a-z-]+)-([0-9]{4})\\.xml: added ([0-9]+), duplicates ([0-9]+), rejected ([0-9]+)'"


@query(f"SELECT regexp_extract(line, {_ADDED}, 1) AS entity, CAST(regexp_extract(line, {_ADDED}, 2) AS INTEGER) AS year, sum(CAST(regexp_extract(line, {_ADDED}, 3) AS BIGINT))::BIGINT AS added, sum(CAST(regexp_extract(line, {_ADDED}, 4) AS BIGINT))::BIGINT AS duplicates, sum(CAST(regexp_extract(line, {_ADDED}, 5) AS BIGINT))::BIGINT AS rejected FROM {_LOG} WHERE regexp_matches(line, {_ADDED}) GROUP BY 1, 2")
def log_import_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that import logs report, by entity and year."""
    p = r"([a-z-]+)-([0-9]{4})\.xml: added ([0-9]+), duplicates ([0-9]+), rejected ([0-9]+)"
    part = lambda i: F.regexp_extract("line", p, i)
    lines = _log(spark, sf).where(F.col("line").rlike(p))
    return lines.groupBy(part(1).alias("entity"), part(2).cast("int").alias("year")).agg(*[F.sum(part(i).cast("bigint")).alias(n) for i, n in ((3, "added"), (4, "duplicates"), (5, "rejected"))])


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(regexp_extract(line, 'declared count ([0-9]+)', 1) AS INTEGER) - CAST(regexp_extract(line, 'from ([0-9]+) records', 1) AS INTEGER) AS missing FROM {_LOG} WHERE regexp_matches(line, 'declared count [0-9]+ differs from [0-9]+ records')")
def count_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose declared count isn't the number of their records, as logs report it."""
    lines = _log(spark, sf).where(F.col("line").rlike("declared count [0-9]+ differs from [0-9]+ records"))
    return lines.select("doc_id", "line_no", (F.regexp_extract("line", "declared count ([0-9]+)", 1).cast("int") - F.regexp_extract("line", "from ([0-9]+) records", 1).cast("int")).alias("missing"))


@query("SELECT doc_id FROM documents WHERE source = 'report' ORDER BY stored_at DESC, doc_id LIMIT 10")
def newest_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The ten newest reports."""
    return table(spark, sf, "documents").where("source = 'report'").orderBy(F.desc("stored_at"), "doc_id").limit(10).select("doc_id")


@query("SELECT source, sha256('{\"source\":\"' || source || '\",\"n\":' || count(*) || ',\"chars\":' || sum(n_chars) || '}') AS checksum FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def snapshot_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """A checksum of the JSON of each aggregate."""
    a = table(spark, sf, "documents").where("n_chars is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return a.select("source", F.sha2(F.to_json(F.struct("source", "n", "chars")), 256).alias("checksum"))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN address IS NULL THEN 'no-address' END, CASE WHEN NOT regexp_full_match(address, '\\+?[0-9\\s().-]+') THEN 'bad-address' END, CASE WHEN lang IS NULL OR NOT regexp_full_match(lang, '[a-z]{2}') THEN 'bad-language' END,
  CASE WHEN stored_at < sent_at THEN 'stored-before-sent' END, CASE WHEN length(text) <> n_chars THEN 'bad-length' END], lambda x: x IS NOT NULL)) AS violation FROM documents""")
def input_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One row per text and rule of form that it breaks."""
    good = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    rules = violations(
        (F.col("address").isNull(), "no-address"), (F.col("address").isNotNull() & ~good("address", r"^\+?[0-9\s().-]+$"), "bad-address"), (~good("lang", "^[a-z]{2}$"), "bad-language"),
        (F.col("stored_at") < F.col("sent_at"), "stored-before-sent"), (F.length("text") != F.col("n_chars"), "bad-length"),
    )
    return table(spark, sf, "documents").select("doc_id", F.explode(rules).alias("violation"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END >= 2 GROUP BY event_type")
def severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events from a severity on."""
    ranks = F.create_map(*[F.lit(x) for kv in {"error": 3, "purchase": 2, "signup": 1}.items() for x in kv])
    e = table(spark, sf, "events").where(F.coalesce(ranks[F.col("event_type")], F.lit(0)) >= 2)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN ['N'] WHEN 'F' THEN ['A','R'] ELSE ['A','N','R'] END AS want FROM orders)
  SELECT w.k AS order_key, array_to_string(list_sort(list_filter(want, lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(want, x))), ',') AS unexpected FROM w JOIN a USING (k) WHERE len(list_filter(want, lambda x: NOT list_contains(have, x))) + len(list_filter(have, lambda x: NOT list_contains(want, x))) > 0""")
def array_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """What a list lacks and has too much against the expected one, both ways."""
    have = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_set("l_returnflag").alias("have"))
    s = F.col("o_orderstatus")
    want = F.when(s == "O", F.array(F.lit("N"))).when(s == "F", F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    both = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), want.alias("want")).join(have, "order_key")
    out = both.select("order_key", F.array_join(F.array_sort(F.array_except("want", "have")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("have", "want")), ",").alias("unexpected"))
    return out.where("missing <> '' or unexpected <> ''")


_BLOCKS = "(SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i))"


@query(f"""WITH f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM {_BLOCKS})
  SELECT doc_id, CAST((k + 1) // 2 AS BIGINT) AS block, count(*) AS n_lines, count(*) FILTER (line LIKE '%WARN%') AS warnings FROM f WHERE k % 2 = 1 AND line NOT LIKE '```%' GROUP BY 1, 2""")
def fenced_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Fenced blocks with their lines and warnings."""
    lines = X.lines_of(table(spark, sf, "documents"), "text", "doc_id")
    fence = F.col("line").startswith("```")
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lines.withColumn("k", F.sum(fence.cast("int")).over(order)).where((F.col("k") % 2 == 1) & ~fence)
    return inside.groupBy("doc_id", F.floor((F.col("k") + 1) / 2).alias("block")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.contains("line", F.lit("WARN"))).alias("warnings"))


@query(f"""SELECT doc_id, arg_min(regexp_replace(line, '^#+ +', ''), line_no) FILTER (regexp_matches(line, '^#+ ')) AS title, arg_min(line, line_no) FILTER (line <> '' AND NOT regexp_matches(line, '^(#|-|```)')) AS paragraph, count(*) FILTER (regexp_matches(line, '^- ')) AS bullets FROM {_BLOCKS} GROUP BY doc_id""")
def document_outline(spark: SparkSession, sf: str) -> DataFrame:
    """First heading, first paragraph and bullets of each text."""
    lines = X.lines_of(table(spark, sf, "documents"), "text", "doc_id")
    heading, plain = F.col("line").rlike("^#+ "), (F.col("line") != "") & ~F.col("line").rlike("^(#|-|```)")
    first = lambda c, v: F.min_by(F.when(c, v), F.when(c, F.col("line_no")))
    return lines.groupBy("doc_id").agg(first(heading, F.regexp_replace("line", "^#+ +", "")).alias("title"), first(plain, F.col("line")).alias("paragraph"), F.count_if(F.col("line").rlike("^- ")).alias("bullets"))


@query(f"""WITH h AS (SELECT doc_id, lower(regexp_replace(line, '^#+ +', '')) AS title FROM {_BLOCKS} WHERE regexp_matches(line, '^#+ ')), p AS (SELECT DISTINCT title FROM h)
  SELECT p.title, count(DISTINCT d.doc_id) AS mentions FROM p JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents WHERE text IS NOT NULL) d ON d.word = p.title GROUP BY p.title""")
def mentions_of_headings(spark: SparkSession, sf: str) -> DataFrame:
    """In how many texts the word of a heading occurs: an equi-join on words."""
    d = table(spark, sf, "documents").where("text is not null")
    lines = X.lines_of(d, "text", "doc_id")
    titles = lines.where(F.col("line").rlike("^#+ ")).select(F.lower(F.regexp_replace("line", "^#+ +", "")).alias("title")).distinct()
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("title"))
    return words.join(titles, "title", "left_semi").groupBy("title").agg(F.count(F.lit(1)).alias("mentions"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'mixed' WHEN bool_and(o_orderstatus = 'F') THEN 'final' WHEN count(DISTINCT o_orderpriority) = 1 THEN 'single' ELSE 'several' END AS category FROM orders GROUP BY o_custkey")
def set_categories(spark: SparkSession, sf: str) -> DataFrame:
    """A category for each set of rows."""
    f, o = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    c = F.when(F.bool_or(f) & F.bool_or(o), "mixed").when(F.bool_and(f), "final").when(F.count_distinct("o_orderpriority") == 1, "single").otherwise("several")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(c.alias("category"))


@query("SELECT c.c_custkey, coalesce(p.c_mktsegment, c.c_mktsegment) AS segment, list_aggregate(list_sort(list_distinct([c.c_mktsegment, p.c_mktsegment, 'all'])), 'string_agg', ',') AS tools FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 2 AND c.c_custkey % 2 = 0")
def template_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows merged with their template: its value wins, sets are united."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    p = c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.col("c_mktsegment").alias("parent"))
    tools = F.array_sort(F.array_distinct(F.filter(F.array("c_mktsegment", "parent", F.lit("all")), lambda x: x.isNotNull())))
    return c.join(p, "c_custkey", "left").select("c_custkey", F.coalesce("parent", "c_mktsegment").alias("segment"), F.array_join(tools, ",").alias("tools"))


@query("SELECT call_id, needs FROM (SELECT call_id, CASE WHEN call_id % 7 = 0 THEN call_id * 2 ELSE call_id - 1 END AS needs FROM calls) c WHERE needs NOT IN (SELECT call_id FROM calls)")
def missing_prerequisites(spark: SparkSession, sf: str) -> DataFrame:
    """References that have no target in the same table."""
    c = table(spark, sf, "calls").select("call_id", F.when(F.col("call_id") % 7 == 0, F.col("call_id") * 2).otherwise(F.col("call_id") - 1).alias("needs"))
    return c.join(c.select(F.col("call_id").alias("needs")), "needs", "left_anti").select("call_id", "needs")


@query("SELECT source, round(0.25 * avg(CASE WHEN n_chars > 0 THEN 100.0 ELSE 0 END) + 0.25 * avg(CASE WHEN lang = 'en' THEN 100.0 ELSE 0 END) + 0.5 * avg(CASE WHEN address IS NOT NULL THEN 100.0 ELSE 0 END), 2)::DOUBLE AS score FROM documents GROUP BY source")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    """A weighted score of shares."""
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    score = 0.25 * share(F.col("n_chars") > 0) + 0.25 * share(F.col("lang") == "en") + 0.5 * share(F.col("address").isNotNull())
    return table(spark, sf, "documents").groupBy("source").agg(F.round(score, 2).alias("score"))


@query("SELECT number, count(*) AS n FROM calls WHERE number IS NOT NULL GROUP BY number ORDER BY n DESC, number LIMIT 20")
def top_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most frequent numbers as written."""
    return A.top_k(table(spark, sf, "calls").where("number is not null"), "number", 20)


@query("SELECT device_id, state, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT device_id, strlen(coalesce(record_text, '')) AS size, CASE WHEN record_text LIKE '<call%' THEN 'element' WHEN record_text LIKE '{%' THEN 'braces' ELSE 'plain' END AS state FROM call_dump) GROUP BY CUBE (device_id, state)")
def layout_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Records and bytes by device, by layout, by both and in all."""
    t = F.coalesce("record_text", F.lit(""))
    state = F.when(t.startswith("<call"), "element").when(t.startswith("{"), "braces").otherwise("plain")
    return table(spark, sf, "call_dump").select("device_id", state.alias("state"), F.octet_length(t).alias("size")).cube("device_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("SELECT type, action, count(*) AS n FROM (SELECT CASE WHEN name IS NULL THEN 'no-name' WHEN coalesce(len(numbers), 0) = 0 THEN 'no-numbers' ELSE 'fine' END AS type, CASE WHEN name IS NULL THEN 'skip' WHEN coalesce(len(numbers), 0) = 0 THEN 'fix' ELSE 'keep' END AS action FROM contacts) GROUP BY ALL")
def repair_plan(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a repair would fix, skip and keep."""
    empty = F.coalesce(F.size("numbers"), F.lit(0)) <= 0
    kind = F.when(F.col("name").isNull(), "no-name").when(empty, "no-numbers").otherwise("fine")
    action = F.when(F.col("name").isNull(), "skip").when(empty, "fix").otherwise("keep")
    return table(spark, sf, "contacts").groupBy(kind.alias("type"), action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT zone_id, count(*) AS calls, count(DISTINCT c.device_id) AS devices, min(c.received_at) AS first_at, max(c.received_at) AS last_at FROM calls c JOIN devices d USING (device_id) GROUP BY zone_id")
def calls_per_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and devices of each zone, with the first and last receipt."""
    d = table(spark, sf, "devices").select("device_id", "zone_id")
    c = table(spark, sf, "calls").select("device_id", "received_at").join(d, "device_id")
    return c.groupBy("zone_id").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("device_id").alias("devices"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))
