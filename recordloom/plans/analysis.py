"""Queries over logs, texts and small graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import graphs as G
from recordloom.operators import stats as A
from recordloom.operators import textscan as X
from recordloom.plans.registry import Registry
from recordloom.sources.tables import table

query = Registry()


@query("SELECT event_id FROM events WHERE contains(lower(event_type || ' ' || props), '7') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'error')")
def audit_search(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a time range and of two types whose fields hold a text; the range and the types reach the scan."""
    e = table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-20' and event_type in ('click', 'error')")
    return e.where(F.contains(F.lower(F.concat_ws(" ", "event_type", "props")), F.lit("7"))).select("event_id")


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS grp, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (grp), ())")
def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Events by type, by group of users and in all, in one pass."""
    e = table(spark, sf, "events").withColumn("grp", F.col("user_id") % 10)
    return e.groupingSets([["event_type"], ["grp"], []], "event_type", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, unnest(list_filter([CASE WHEN user_id IS NULL THEN 'missing-user' END, CASE WHEN event_type NOT IN ('signup','click','view','purchase') THEN 'bad-type' END, CASE WHEN value < 0 THEN 'negative-value' END], lambda x: x IS NOT NULL)) AS violation FROM events")
def audit_validate(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event and rule that it breaks."""
    from recordloom.operators.quality import violations

    rules = violations((F.col("user_id").isNull(), "missing-user"), (~F.col("event_type").isin("signup", "click", "view", "purchase"), "bad-type"), (F.col("value") < 0, "negative-value"))
    return table(spark, sf, "events").select("event_id", F.explode(rules).alias("violation"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def recent_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """The last three events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_id")


@query("SELECT source, lang, count(*) AS total, count(*) FILTER (n_chars > 100) AS covered, coalesce(round(count(*) FILTER (n_chars > 100) * 100.0 / nullif(count(*), 0), 2), 0) AS percent FROM documents GROUP BY ROLLUP (source, lang)")
def coverage_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Share of long texts by source and language, with totals."""
    return A.coverage(table(spark, sf, "documents"), F.col("n_chars") > 100, "source", "lang")


@query("""SELECT user_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT user_id, CAST(round(greatest(0, least(100, 100 - sum(CASE event_type WHEN 'error' THEN 5.0 WHEN 'click' THEN 0.5 ELSE 0 END))), 2) AS DOUBLE) AS score FROM events GROUP BY user_id)""")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """Score and grade of each user by weighted event types."""
    return A.penalty_score(table(spark, sf, "events"), "event_type", {"error": 5.0, "click": 0.5}, "user_id").withColumn("grade", A.grade())


@query("SELECT o_custkey, arg_max(s, CASE s WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) AS status FROM (SELECT o_custkey, o_orderstatus AS s FROM orders) GROUP BY o_custkey")
def worst_status(spark: SparkSession, sf: str) -> DataFrame:
    """The worst status of each group."""
    return A.worst(table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus")), "status", {"F": 2, "P": 1, "O": 0}, "o_custkey")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase of each user."""
    return table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_LINES = "(SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i))"
_FENCED = f"(SELECT *, (sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1) OR line LIKE '```%' AS in_fence FROM {_LINES})"
_HEADED = f"(SELECT *, regexp_matches(line, '^#{{1,6}} ') AND NOT in_fence AS is_heading FROM {_FENCED})"
_SECTIONED = f"(SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section, last_value(CASE WHEN is_heading THEN regexp_replace(line, '^#+ +', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM {_HEADED})"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.lines_of(table(spark, sf, "documents"), "text", "doc_id")


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, in_fence, is_heading, CAST(section AS BIGINT) AS section, title FROM {_SECTIONED}")
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Section number, fence state and title of every line of the longer texts."""
    return X.containing_section(X.sections(_lines(spark, sf), "doc_id"), "doc_id").select("doc_id", "line_no", "in_fence", "is_heading", "section", "title")


@query(f"SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, sum(length(line)) AS chars, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS fingerprint FROM {_SECTIONED} GROUP BY doc_id, section")
def section_prints(spark: SparkSession, sf: str) -> DataFrame:
    """Size and fingerprint of each section."""
    s = X.sections(_lines(spark, sf), "doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return s.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.sha2(text, 256).alias("fingerprint"))


@query(f"SELECT title, count(DISTINCT doc_id) AS n, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 _-]', '', 'g'), '[ ]+', '-', 'g'), '-') AS anchor FROM {_SECTIONED} WHERE is_heading GROUP BY title")
def anchors_of_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, how many texts have them, and their anchors."""
    s = X.containing_section(X.sections(_lines(spark, sf), "doc_id"), "doc_id").where("is_heading")
    return s.groupBy("title").agg(F.count_distinct("doc_id").alias("n")).withColumn("anchor", S.slug("title"))


@query("""SELECT doc_id, array_to_string(list_distinct_keep, '|') AS refs FROM (SELECT doc_id, list_reduce(list_concat([''::VARCHAR], list_concat(regexp_extract_all(text, '"(--[a-z-]+)"', 1), regexp_extract_all(text, '([a-z-]+-[0-9]{4}\\.xml)', 1))), lambda a, b: a || chr(1) || b) AS j, list_concat(regexp_extract_all(text, '"(--[a-z-]+)"', 1), regexp_extract_all(text, '([a-z-]+-[0-9]{4}\\.xml)', 1)) AS l FROM documents WHERE text IS NOT NULL) t,
  LATERAL (SELECT list(v ORDER BY p) AS list_distinct_keep FROM (SELECT v, min(p) AS p FROM (SELECT unnest(l) AS v, unnest(range(len(l))) AS p) GROUP BY v)) x WHERE len(l) > 0""")
def code_references(spark: SparkSession, sf: str) -> DataFrame:
    """Options and file names that a text mentions, each once, in order."""
    refs = X.references(F.col("text"), (r'"(--[a-z-]+)"', r"([a-z-]+-[0-9]{4}\.xml)"))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", refs.alias("r"))
    return d.where(F.size("r") > 0).select("doc_id", F.array_join("r", "|").alias("refs"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s]+)', 1)) AS url FROM documents WHERE text IS NOT NULL")
def links(spark: SparkSession, sf: str) -> DataFrame:
    """Links in texts, one row each."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s]+)"), F.lit(1))).alias("url"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS words, CAST(ceil(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) / 225.0) AS INTEGER) AS minutes,
  CAST(contains(lower(coalesce(text, '')), 'backup') AS INTEGER) + CAST(contains(lower(coalesce(text, '')), 'import') AS INTEGER) AS hits FROM documents""")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Words, minutes to read and keywords of each text."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.words(t).cast("bigint").alias("words"), X.reading_minutes(t).alias("minutes"), X.keyword_hits(t, ("backup", "import")).alias("hits"))


_PATHS = "(SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'docs/a.txt' WHEN 1 THEN 'src/../x.py' WHEN 2 THEN '/etc/x.yaml' WHEN 3 THEN 'tests/x.py' WHEN 4 THEN 'src/x.py' ELSE 'bin/x' END AS path FROM part)"


_TREE = "(SELECT n_nationkey AS node, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS needs FROM nation)"


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """The nations as a binary tree of tasks."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("node"), F.when(k > 0, F.floor(k / 2)).alias("needs"))


@query(f"WITH RECURSIVE w(node, level) AS (SELECT node, 0 FROM {_TREE} WHERE needs IS NULL UNION ALL SELECT e.node, w.level + 1 FROM w JOIN {_TREE} e ON e.needs = w.node) SELECT node, max(level) AS level FROM w GROUP BY node")
def task_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level of each task behind its prerequisites."""
    return G.levels(_tree(spark, sf))


@query(f"WITH RECURSIVE w(node, finish) AS (SELECT node, node % 5 + 1 FROM {_TREE} WHERE needs IS NULL UNION ALL SELECT e.node, w.finish + e.node % 5 + 1 FROM w JOIN {_TREE} e ON e.needs = w.node) SELECT node, max(finish) AS finish FROM w GROUP BY node")
def critical_path(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest finish of each task."""
    t = _tree(spark, sf)
    return G.critical_path(t.select("node", (F.col("node") % 5 + 1).alias("duration")), t)


@query(f"WITH RECURSIVE w(node, reached) AS (SELECT node, needs FROM {_TREE} WHERE needs IS NOT NULL UNION SELECT w.node, e.needs FROM w JOIN {_TREE} e ON e.node = w.reached WHERE e.needs IS NOT NULL) SELECT node, reached FROM w")
def role_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All ancestors of each node."""
    return G.closure(_tree(spark, sf).withColumnRenamed("needs", "next"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def broken_references(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose reference has no target."""
    n = table(spark, sf, "nation").where("n_regionkey = 2")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey")


@query("SELECT doc_id, given FROM documents d JOIN nicknames n ON contains(d.text, n.given || ' ') GROUP BY ALL")
def given_names_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold a given name followed by a blank: words are joined, no text meets all names."""
    d = table(spark, sf, "documents").where("text is not null")
    n = table(spark, sf, "nicknames").where("given is not null").select(F.col("given").alias("nick"), "given").distinct()
    # a name that ends in front of a blank ends a word; all ends of words are looked up
    lengths = [r[0] for r in n.select(F.length("nick").alias("n")).groupBy("n").count().select("n").collect()]  # one row per length
    ends = F.explode(F.array_distinct(F.flatten(F.transform(F.filter(F.split("text", " "), lambda w: w.isNotNull()), lambda w: F.array(*[F.substring(w, -k, k) for k in lengths] or [F.lit("")])))))
    heads = F.expr("substring(text, 1, length(text) - locate(' ', reverse(text)))")
    return d.where(F.contains("text", F.lit(" "))).select("doc_id", heads.alias("text")).select("doc_id", ends.alias("nick")).join(n, "nick").select("doc_id", "given").distinct()


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, count(*) FILTER (value > 50) AS high, round(count(*) FILTER (value > 50) * 100.0 / count(*), 2) AS high_share FROM events GROUP BY event_type")
def progress_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, mean and share by type."""
    high = F.count_if(F.col("value") > 50)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), high.alias("high"), A.share(high, F.count(F.lit(1))).alias("high_share"))


@query("SELECT least(floor(value / 25), 4) AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A histogram with fixed buckets."""
    return table(spark, sf, "events").groupBy(F.least(F.floor(F.col("value") / 25), F.lit(4)).cast("double").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS since_us, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def status_history(spark: SparkSession, sf: str) -> DataFrame:
    """The previous event of each event and the time since."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("user_id", "event_id", (t - F.lag(t).over(w)).alias("since_us"), F.lag("event_type").over(w).alias("before"))


@query("SELECT n_name AS name FROM nation EXCEPT SELECT c_mktsegment FROM customer UNION SELECT DISTINCT r_name FROM region")
def name_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Union and difference of name sets."""
    n, c, r = table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "customer").select("c_mktsegment"), table(spark, sf, "region").select("r_name")
    return n.distinct().subtract(c).union(r).distinct()
