"""Queries over parts, attachments, manifests, violations and totals of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import attachments as T
from recordloom.operators import integrity as I
from recordloom.operators import quality as Q
from recordloom.operators import stats as A
from recordloom.plans.records import TYPED, YEAR, typed_calls
from recordloom.plans.registry import Registry
from recordloom.sources.tables import table

query = Registry()


def _messages_with_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as messages and their lines as parts in order of the line number."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("ct"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("data")).alias("part"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("part")).alias("parts"))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, concat_ws('-', l_partkey, l_suppkey)) - 1 AS INTEGER) AS pos, l_linenumber AS seq, l_returnflag AS ct FROM lineitem")
def parts_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Nested parts as rows with their place."""
    return T.explode_parts(_messages_with_parts(spark, sf), "l_orderkey").select("l_orderkey", "pos", "seq", "ct")


@query("""SELECT l_orderkey, sum(strlen(d)) AS size, string_agg('attachments/' || substr(sha256(d), 1, 2) || '/' || sha256(d), '|' ORDER BY l_linenumber, l_returnflag, d) AS paths
  FROM (SELECT *, concat_ws('-', l_partkey, l_suppkey) AS d FROM lineitem) GROUP BY l_orderkey""")
def parts_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose content is replaced by its address and size, order kept."""
    m = _messages_with_parts(spark, sf).withColumn("parts", T.mark_extracted("parts"))
    return m.select("l_orderkey", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["original_size"]).alias("size"), F.array_join(F.transform("parts", lambda p: p["path"]), "|").alias("paths"))


@query("SELECT l_orderkey, sum(strlen(concat_ws('-', l_partkey, l_suppkey)) + strlen(l_returnflag)) AS bytes FROM lineitem GROUP BY l_orderkey")
def parts_size(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the parts of each message."""
    parts = F.transform("parts", lambda p: F.struct(p["data"].alias("data"), p["ct"].alias("ct"), F.lit("").alias("name")))
    return _messages_with_parts(spark, sf).withColumn("parts", parts).select("l_orderkey", Q.parts_bytes("parts").cast("bigint").alias("bytes"))


@query("SELECT sha256(text) AS hash, count(*) AS \"references\", min(doc_id) AS doc_id, 'attachments/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def attachment_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct content with its address, first holder and references."""
    return T.content_addresses(table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "utf-8").alias("content")), "content", "doc_id")


@query("""SELECT DISTINCT sha256(text) AS hash, CASE WHEN text LIKE '#%' THEN 'text/markdown' WHEN text LIKE '<%' THEN 'text/html' ELSE 'text/plain' END AS detected, CASE source WHEN 'manual' THEN 'text/markdown' ELSE 'text/plain' END AS declared
  FROM documents WHERE text IS NOT NULL AND CASE WHEN text LIKE '#%' THEN 'text/markdown' WHEN text LIKE '<%' THEN 'text/html' ELSE 'text/plain' END <> CASE source WHEN 'manual' THEN 'text/markdown' ELSE 'text/plain' END""")
def mime_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Contents whose type isn't the declared one."""
    d = table(spark, sf, "documents").where("text is not null").withColumn("hash", F.sha2("text", 256))
    detected = F.when(F.col("text").startswith("#"), "text/markdown").when(F.col("text").startswith("<"), "text/html").otherwise("text/plain")
    return T.type_mismatches(d.select("hash", detected.alias("detected")).distinct(), d.select("hash", F.when(F.col("source") == "manual", " Text/Markdown; charset=utf-8").otherwise("text/plain").alias("ct")).distinct())


@query(f"SELECT year, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual FROM (SELECT {YEAR} AS year, count(*) AS n FROM {TYPED} WHERE batch_no = 0 GROUP BY 1) e FULL JOIN (SELECT {YEAR} AS year, count(*) AS n FROM {TYPED} WHERE batch_no < 3 GROUP BY 1) a USING (year) WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)")
def year_count_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Years whose number of calls changed with the first two batches."""
    c = typed_calls(spark, sf).withColumn("year", S.utc_year("date"))
    return I.compare_counts(c.where("batch_no = 0").groupBy("year").agg(F.count(F.lit(1)).alias("n")), c.where("batch_no < 3").groupBy("year").agg(F.count(F.lit(1)).alias("n")), "year")


_ENTRIES = "(SELECT CASE WHEN l_orderkey % 50 = 0 THEN '/f' WHEN l_orderkey % 51 = 0 THEN '../f' ELSE 'f' END || l_orderkey AS name, CAST(l_quantity AS BIGINT) - 2 AS size, 'sha256:' || CASE WHEN l_linenumber = 3 THEN 'x' ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS checksum, l_linenumber FROM lineitem)"


@query(f"""SELECT name, unnest(list_filter([CASE WHEN NOT regexp_full_match(checksum, 'sha256:[0-9a-f]{{64}}') THEN 'bad-checksum' END, CASE WHEN size <= 0 THEN 'bad-size' END, CASE WHEN name LIKE '/%' THEN 'absolute-path' END, CASE WHEN contains(name, '..') THEN 'parent-path' END,
  CASE WHEN row_number() OVER (PARTITION BY name ORDER BY size) > 1 THEN 'duplicate-entry' END], lambda x: x IS NOT NULL)) AS fault FROM {_ENTRIES}""")
def manifest_format_check(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of manifest entries."""
    k = F.col("l_orderkey")
    head = F.when(k % 50 == 0, "/f").when(k % 51 == 0, "../f").otherwise("f")
    entries = table(spark, sf, "lineitem").select(F.concat(head, k.cast("string")).alias("name"), (F.col("l_quantity").cast("bigint") - 2).alias("size"), F.concat(F.lit("sha256:"), F.when(F.col("l_linenumber") == 3, "x").otherwise(F.sha2(F.col("l_partkey").cast("string"), 256))).alias("checksum"))
    return I.manifest_faults(entries)


@query(f"SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS years FROM (SELECT {YEAR} AS y FROM {TYPED} UNION SELECT CAST(year(sent_at) AS INTEGER) FROM documents WHERE sent_at IS NOT NULL)")
def years_covered(spark: SparkSession, sf: str) -> DataFrame:
    """The years of calls and documents."""
    return A.years_covered(typed_calls(spark, sf).select(S.utc_year("date").alias("year")), table(spark, sf, "documents").select(F.year("sent_at").alias("year")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The three most frequent sources."""
    return A.top_k(table(spark, sf, "documents"), "source", 3)


@query("SELECT source, count(*) AS n, sum(n_chars) AS chars, sum(n_chars) FILTER (n_chars > 1000) AS long_chars FROM documents GROUP BY ROLLUP (source)")
def attachment_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Number and size by type, and in all."""
    return table(spark, sf, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum(F.when(F.col("n_chars") > 1000, F.col("n_chars"))).alias("long_chars"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.1f MB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.1f KB', n_chars / 1024.0) ELSE n_chars || ' B' END AS size FROM documents WHERE n_chars IS NOT NULL""")
def size_format(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes with a unit."""
    return table(spark, sf, "documents").where("n_chars is not null").select("doc_id", S.format_size(F.col("n_chars").cast("bigint")).alias("size"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_type || '/..' || p_brand, '\\.\\.', '_', 'g'), '[/\\\\:]', '_', 'g') AS file_name,
  CASE p_size % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'pdf' WHEN 2 THEN 'bin' ELSE 'mp3' END AS extension FROM part""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Safe file names and extensions of MIME types."""
    ct = F.when(F.col("p_size") % 4 == 0, "IMAGE/JPEG; q=1").when(F.col("p_size") % 4 == 1, "application/pdf").when(F.col("p_size") % 4 == 2, "x/y").otherwise(" audio/mpeg ")
    return table(spark, sf, "part").select("p_partkey", S.safe_filename(F.concat("p_type", F.lit("/.."), "p_brand")).alias("file_name"), S.mime_extension(ct).alias("extension"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS known, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
def seen_before(spark: SparkSession, sf: str) -> DataFrame:
    """Membership and number of references of each key."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.col("n").isNotNull().alias("known"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT call_id, row_number() OVER (PARTITION BY number, date, duration, type ORDER BY call_id) > 1 AS duplicate, first_value(call_id) OVER (PARTITION BY number, date, duration, type ORDER BY call_id) AS first_id FROM " + TYPED)
def duplicate_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Is a call an exact repetition, and of which one?"""
    from pyspark.sql import Window

    w = Window.partitionBy("number", "date", "duration", "type").orderBy("call_id")
    return typed_calls(spark, sf).select("call_id", (F.row_number().over(w) > 1).alias("duplicate"), F.first("call_id").over(w).alias("first_id"))
