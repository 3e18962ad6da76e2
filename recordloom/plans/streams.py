"""Queries that run a stream over a table to its end and give its result."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.registry import Registry
from recordloom.session import application_scratch, file_system
from recordloom.sources.tables import table
from recordloom.streaming import imports as M

query = Registry()


#: More files than any table has: all are read in one trigger, so that no row is late by the order of files.
ALL_FILES = 2**31 - 1


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream: its file or its part files, each read once."""
    schema = table(spark, sf, name).schema
    return M.stream_table(spark, f"{sf}/{name}.parquet*", schema, ALL_FILES)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = f"{application_scratch(spark)}/{uuid.uuid4().hex}"
    _finish(stream, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _finish(stream: DataFrame, out: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _run_to_end(spark: SparkSession, source: DataFrame, time: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a windowed operator over a stream that ends, those still open at its end included.

    A second folder of the stream is empty until the source has been read; then it gets
    one row of the far future, which moves the watermark behind every open window. The
    window of that row itself stays open and is never written.
    """
    out = f"{application_scratch(spark)}/{uuid.uuid4().hex}"
    fs, at = file_system(spark, f"{out}/end")
    fs.mkdirs(at)
    stream = operator(source.unionByName(M.stream_table(spark, f"{out}/end", source.schema)))
    _finish(stream, out)
    end = datetime.datetime(2900, 1, 1)
    last = spark.createDataFrame([tuple(end if f.name == time else None for f in source.schema)], source.schema)
    last.coalesce(1).write.mode("append").parquet(f"{out}/end")
    _finish(stream, out)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("""SELECT DISTINCT sha256(concat('number:', number, '|duration:', duration, '|date:', date, '|type:', type, '|')) AS key FROM (
  SELECT number, CAST(trim(duration) AS INTEGER) AS duration, CAST(trim(date) AS BIGINT) AS date, CAST(trim(type) AS INTEGER) AS type FROM calls
  WHERE number IS NOT NULL AND regexp_full_match(trim(date), '[0-9]{1,18}') AND regexp_full_match(trim(duration), '[0-9]{1,9}') AND trim(type) IN ('1','2','3','4'))""")
def streaming_import(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of a store filled by a stream of calls."""
    from recordloom.operators.coalesce import call_key

    d, n, t = F.trim("date"), F.trim("duration"), F.trim("type")
    good = F.col("number").isNotNull() & d.rlike("^[0-9]{1,18}$") & n.rlike("^[0-9]{1,9}$") & t.isin("1", "2", "3", "4")
    calls = _source(spark, sf, "calls").where(good).select("call_id", "batch_no", "number", n.cast("int").alias("duration"), d.cast("bigint").alias("date"), t.cast("int").alias("type"))
    out = f"{application_scratch(spark)}/{uuid.uuid4().hex}"
    M.import_stream(calls, f"{out}/store", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/store").select(call_key().alias("key"))


@query("SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events")
def streaming_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Users, types and minutes, each once, by a stream with bounded state."""
    e = _source(spark, sf, "events").select("user_id", "event_type", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"))
    kept = M.deduplicated(e, ["user_id", "event_type", "minute"], "minute")
    return _run(spark, kept).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events by hour and type, all windows closed at the end of the stream."""
    events = _source(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    return _run_to_end(spark, events, "at", lambda e: M.windowed_counts(e, "at", "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY user_id, s""")
def streaming_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users, all closed at the end of the stream."""
    events = _source(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    done = _run_to_end(spark, events, "at", lambda e: M.sessions(e, "at", "user_id"))
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def streaming_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each user, none within half an hour behind the last one."""
    return _run(spark, M.suppressed(_source(spark, sf, "events").where("event_type = 'error'"), "user_id", "ts"))


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def session_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user over the whole table: the operator of the stream on a batch."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return M.sessions(e, "at", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
