"""Queries of chains, histories, scans, rates, renderings and audit logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators import graphs as G
from recordloom.operators import tracking as K
from recordloom.plans.registry import Registry
from recordloom.plans.whole import _REPORT, _report
from recordloom.session import application_scratch
from recordloom.sources.tables import table

query = Registry()

_PARENTS = "(SELECT n_nationkey AS node, CASE n_nationkey WHEN 0 THEN NULL WHEN 20 THEN 21 WHEN 21 THEN 20 ELSE n_nationkey // 3 END AS parent FROM nation)"


@query(f"WITH RECURSIVE w(node, chain) AS (SELECT node, CAST(node AS VARCHAR) FROM {_PARENTS} WHERE parent IS NULL UNION ALL SELECT e.node, w.chain || '>' || e.node FROM w JOIN {_PARENTS} e ON e.parent = w.node) SELECT n_nationkey AS node, chain FROM nation LEFT JOIN w ON node = n_nationkey")
def inheritance_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of each template from its root; templates on a cycle have none."""
    k = F.col("n_nationkey")
    parent = F.when(k == 20, 21).when(k == 21, 20).when(k > 0, F.floor(k / 3))
    chains = K.inheritance(table(spark, sf, "nation").select(k.alias("node"), parent.cast("bigint").alias("parent")))
    return chains.select(F.col("node").cast("int").alias("node"), F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


_TREE = "(SELECT n_nationkey AS node, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS needs, n_regionkey AS priority FROM nation)"


@query(f"""WITH RECURSIVE w(node, level) AS (SELECT node, 0 FROM {_TREE} WHERE needs IS NULL UNION ALL SELECT e.node, w.level + 1 FROM w JOIN {_TREE} e ON e.needs = w.node),
  d AS (SELECT node, (SELECT count(*) FROM {_TREE} x WHERE x.needs = t.node) AS needed_by, priority FROM {_TREE} t)
  SELECT node, level, row_number() OVER (PARTITION BY level ORDER BY priority DESC, needed_by, node) AS place FROM w JOIN d USING (node)""")
def task_order(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks by level, within it by priority, fewest dependants and number."""
    k = F.col("n_nationkey")
    t = table(spark, sf, "nation").select(k.alias("node"), F.when(k > 0, F.floor(k / 2)).alias("needs"), F.col("n_regionkey").alias("priority"))
    wanted = t.where("needs is not null").groupBy(F.col("needs").alias("node")).agg(F.count(F.lit(1)).alias("needed_by"))
    both = G.levels(t).join(t.select("node", "priority"), "node").join(wanted, "node", "left").withColumn("needed_by", F.coalesce("needed_by", F.lit(0)))
    order = Window.partitionBy("level").orderBy(F.desc("priority"), "needed_by", "node")
    return both.select(F.col("node").cast("int").alias("node"), "level", F.row_number().over(order).alias("place"))


@query("SELECT user_id, event_id, event_type, nth FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last five events of each user, the newest first."""
    return K.last_of_each(table(spark, sf, "events"), "user_id", 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "nth")


@query("""WITH b AS (SELECT o_orderkey AS path, o_orderdate AS mtime FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_orderkey AS path, CASE WHEN o_orderpriority LIKE '2%' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mtime FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT')
  SELECT change, count(*) AS n, min(path) AS first_path FROM (SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN b.mtime <> n.mtime THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN n ON b.path = n.path) GROUP BY change""")
def scan_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Files between two scans, each in one of them at least (orders as files, dates as times of change)."""
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    before = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("path"), at.alias("mtime"))
    now = o.where("o_orderstatus = 'P' or o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderpriority").startswith("2"), at + F.expr("interval 1 day")).otherwise(at).alias("mtime"))
    return K.file_changes(before, now).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(100.0 * count(*) FILTER (event_type = 'error' AND value > 50) / nullif(count(*) FILTER (event_type = 'error'), 0), 2) AS high_rate FROM events GROUP BY user_id")
def resolution_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each user and the share of high ones; null for users without errors."""
    error = F.col("event_type") == "error"
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.count_if(error & (F.col("value") > 50)).alias("high"))
    return g.select("user_id", "n", "errors", K.rate(F.col("high"), F.col("errors")).alias("high_rate"))


@query("SELECT doc_id, i AS pos, sha256(s[i]) AS fingerprint FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+|\\n'), lambda x: trim(x, ' ')), lambda x: length(x) > 10) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(i)")
def sentence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences and lines of more than ten characters of every text, with their place."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(K.sentences(F.col("text"))).alias("at", "s"))
    return d.select("doc_id", (F.col("at") + 1).cast("bigint").alias("pos"), F.sha2("s", 256).alias("fingerprint"))


@query("SELECT id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z]{2,}-[0-9]+)\\b', 1)) AS id FROM documents WHERE text IS NOT NULL) GROUP BY id")
def mentioned_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of records that texts mention, and in how many texts."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(K.record_ids(F.col("text"))).alias("id"))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS name FROM documents WHERE text IS NOT NULL) GROUP BY name")
def inline_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Calls written in texts, and in how many texts."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(K.inline_calls(F.col("text"))).alias("name"))
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT type, severity, '[' || upper(severity) || '] ' || type || ': ' || file || ' - seq ' || seq AS line FROM {_REPORT}")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The report as lines of text."""
    return _report(spark, sf).select("type", "severity", K.report_line(F.col("type"), F.col("severity"), F.col("file"), F.concat(F.lit("seq "), F.col("seq").cast("string"))).alias("line"))


@query("""SELECT source, '{"source":"' || source || '","n":' || count(*) || ',"texts":' || count(DISTINCT text) || ',"chars":' || CAST(coalesce(sum(n_chars), 0) AS BIGINT) || '}' AS json FROM documents WHERE source IS NOT NULL GROUP BY source""")
def summary_json(spark: SparkSession, sf: str) -> DataFrame:
    """A summary of each source as JSON."""
    g = table(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    return g.select("source", F.to_json(F.struct("source", "n", "texts", "chars")).alias("json"))


@query("SELECT event_type, 2 * count(*) AS n, sum(event_id) * 2 AS ids FROM events GROUP BY event_type")
def audit_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """An audit log of JSON lines that events are appended to twice, read back."""
    folder = f"{application_scratch(spark)}/{uuid.uuid4().hex}"
    for _ in range(2):
        table(spark, sf, "events").select("event_id", "event_type", "user_id").write.mode("append").json(folder)
    return spark.read.schema("event_id bigint, event_type string, user_id bigint").json(folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("decimal(38,0)").alias("ids"))


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN stored_at IS NULL THEN 'unknown' WHEN stored_at <= TIMESTAMP '2022-01-01' THEN 'expired' WHEN stored_at <= TIMESTAMP '2022-07-01' THEN 'soon' ELSE 'valid' END AS state FROM documents) GROUP BY state""")
def expiry_states(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether their time of storing is past, within half a year, or later than a moment."""
    state = K.expiry(F.col("stored_at").cast("timestamp"), F.lit("2022-01-01").cast("timestamp"), "181 days")
    return table(spark, sf, "documents").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(date_diff('day', sent_at, stored_at) AS INTEGER) AS days FROM documents WHERE stored_at - sent_at > INTERVAL 7 DAY")
def long_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored more than seven days behind their sending."""
    d = table(spark, sf, "documents").select("doc_id", F.col("sent_at").cast("timestamp").alias("a"), F.col("stored_at").cast("timestamp").alias("b"))
    return d.where(F.unix_micros("b") - F.unix_micros("a") > 7 * 86_400_000_000).select("doc_id", F.datediff("b", "a").alias("days"))


@query("SELECT sig, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(c_name || ' ( ' || c_mktsegment || ' ,  X )'), '\\s+', ' ', 'g'), ' ?([(),:;#-]) ?', '\\1', 'g')) AS sig FROM customer) GROUP BY sig")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures written with blanks in many places, as one form."""
    text = F.concat("c_name", F.lit(" ( "), "c_mktsegment", F.lit(" ,  X )"))
    return table(spark, sf, "customer").select(K.normalized_signature(text).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT hash, size FROM (SELECT sha256(text) AS hash, min(strlen(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE hash IN (SELECT sha256(text) FROM documents WHERE source = 'report' AND lang = 'de')""")
def attachment_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments (texts by hash) that a list of hashes asks for."""
    d = table(spark, sf, "documents").where("text is not null")
    asked = d.where("source = 'report' and lang = 'de'").select(F.sha2("text", 256).alias("hash")).distinct()
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min(F.octet_length("text")).cast("bigint").alias("size")).join(asked, "hash", "left_semi")
