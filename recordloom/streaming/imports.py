"""Streams: import in micro-batches, de-duplication, windows, suppressed repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from recordloom.operators.coalesce import call_key


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; every file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: First digits of a key that name the part of the store it is in: 16 parts, more digits for stores of many files a part.
PREFIX = 1


def import_stream(calls: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Adds the calls of a stream to a store, each key once for ever.

    Each micro-batch is held against the store by an anti-join, so no state grows with
    the keys and no late row is lost. The store keeps the keys beside the rows, divided
    by the beginning of the key: a batch reads the key column of the parts that its own
    keys fall into, and nothing is hashed twice. A batch writes its own folders under
    its number, so one that runs again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        keyed = batch.withColumn("key", call_key())
        columns = [c for c in keyed.columns if c != "key"]
        first = keyed.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct(*[c for c in ("batch_no", "call_id") if c in columns] or columns)).alias("r")).select("key", "r.*")
        first = first.withColumn("prefix", F.substring("key", 1, PREFIX))
        if fs.exists(jvm_path):
            prefixes = [r[0] for r in keyed.select(F.substring("key", 1, PREFIX).alias("prefix")).distinct().collect()]  # at most 16 ** PREFIX
            schema = StructType([*first.schema.fields, StructField("batch", LongType())])
            held = spark.read.schema(schema).parquet(store).where(F.col("prefix").isin(prefixes) & (F.col("batch") < number)).select("key")
            first = first.join(held, "key", "left_anti")
        first.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/batch={number}")

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, keys: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: bounded state for streams whose repetitions come soon."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """start, by, n of tumbling or sliding windows; late rows count until the watermark passes."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, lateness).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """by, start, end, n of sessions that end after a gap."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, lateness).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def suppressed(events: DataFrame, key: str, time: str, pause_ms: int = 30 * 60 * 1000) -> DataFrame:
    """key, at of the events that aren't within the pause behind the last one let through: state of one number a key, which times out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -(1 << 62)
        times = sorted(t for b in batches for t in (b["at"].astype("int64") // (1_000 if str(b["at"].dtype).startswith("datetime64[us") else 1_000_000)).tolist())
        passed = []
        for t in times:
            if t - last >= pause_ms:
                passed.append(t)
                last = t
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + pause_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(passed), "at_ms": pd.Series(passed, dtype="int64")})

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", "1 hour")
    return keyed.groupBy("key").applyInPandasWithState(run, "key string, at_ms bigint", "last_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)
