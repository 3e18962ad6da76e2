"""Queries that write tables through the sinks and read them back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import quality as Q
from recordloom.plans.records import _VIOLATIONS, TYPED, YEAR, _loose_calls, typed_calls
from recordloom.plans.registry import Registry
from recordloom.session import application_scratch
from recordloom.sinks import store
from recordloom.sources import attachments as scan
from recordloom.sources import xmlrecords
from recordloom.sources.tables import table

query = Registry()


def _folder(spark: SparkSession) -> str:
    return f"{application_scratch(spark)}/{uuid.uuid4().hex}"


_CALL = ["number", "duration", "date", "type", "contact_name"]


@query(f"SELECT number, duration, date, type, contact_name, count(*) AS n FROM {TYPED} GROUP BY ALL")
def xml_calls_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All typed calls written as XML files by year and read by record."""
    folder = _folder(spark)
    store.export_years(typed_calls(spark, sf), folder, "calls", "call", _CALL).collect()  # one row a year
    return xmlrecords.read_calls(spark, folder).groupBy(*_CALL).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'calls-' || {YEAR} || '.xml' AS file, CAST(count(*) AS INTEGER) AS declared, count(*) AS n, CAST(count(*) - 1 AS INTEGER) AS last_pos, min(date) AS first_date FROM {TYPED} GROUP BY 1")
def xml_positions_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Declared count, records, last position and first date of each file: files are written in order of time and read from their root."""
    folder = _folder(spark)
    store.export_years(typed_calls(spark, sf), folder, "calls", "call", _CALL).collect()  # one row a year
    calls = xmlrecords.read_calls_with_position(spark, folder)
    return calls.groupBy("file", "declared").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"), F.min_by("date", "pos").alias("first_date"))


_BODY = "trim(regexp_replace(text, '[^A-Za-z0-9 .,<>&\"]+', ' ', 'g'))"


@query(f"SELECT coalesce(address, '') AS address, epoch_us(sent_at) // 1000 AS date, {_BODY} AS body, count(*) AS n FROM documents WHERE source = 'sms' AND sent_at IS NOT NULL AND text IS NOT NULL GROUP BY ALL")
def xml_messages_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Short messages with signs that XML escapes, written by year and read back."""
    folder = _folder(spark)
    d = table(spark, sf, "documents").where("source = 'sms' and sent_at is not null and text is not null")
    sms = d.select(F.coalesce("address", F.lit("")).alias("address"), S.epoch_ms("sent_at").alias("date"), F.lit(1).alias("type"), F.trim(F.regexp_replace("text", '[^A-Za-z0-9 .,<>&"]+', " ")).alias("body"))
    store.export_years(sms, folder, "smses", "sms", ["address", "date", "type", "body"]).collect()  # one row a year
    return xmlrecords.read_sms(spark, folder).groupBy("address", "date", "body").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {YEAR} AS year, count(*) AS n, count(DISTINCT number) AS numbers, min(date) AS earliest FROM {TYPED} GROUP BY 1")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Calls written to the store by entity and year, all years but the even ones written twice, and read back."""
    folder = _folder(spark)
    calls = typed_calls(spark, sf)
    store.write_years(calls, folder, "calls")
    store.write_years(calls.where("year(timestamp_millis(date)) % 2 = 1"), folder, "calls")
    return store.read_store(spark, folder, "calls").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("numbers"), F.min("date").alias("earliest"))


@query(f"SELECT violation, count(*) AS n FROM {_VIOLATIONS} GROUP BY violation")
def refused_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Refused calls written as JSON lines with their violations and read back."""
    folder = _folder(spark)
    store.write_refused(Q.split_rows(_loose_calls(spark, sf), Q.call_violations())[1], folder, "calls")
    return spark.read.schema("data string, violations array<string>, source string").json(folder).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS hash, strlen(text) AS size, 'written' AS state, 'legacy' AS layout FROM documents WHERE text <> '' GROUP BY ALL")
def attachments_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as attachments below their hashes, repeated ones once, and scanned again; the hash is that of what was read."""
    folder = _folder(spark)
    content = F.encode("text", "utf-8")
    written = store.write_attachments(table(spark, sf, "documents").where("text <> ''").select(F.sha2(content, 256).alias("hash"), content.alias("content")), folder)
    path = f"{folder}/states"
    written.write.parquet(path)
    files = scan.scan(spark, folder)
    return files.join(scan.layout(files), "hash").join(spark.read.parquet(path), "hash").select(F.col("digest").alias("hash"), "size", "state", "layout")


@query(f"SELECT number, date, type, count(*) AS n FROM {TYPED} WHERE {YEAR} = 2020 GROUP BY ALL")
def xml_year_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of one year, whose file alone is read."""
    folder = _folder(spark)
    store.export_years(typed_calls(spark, sf), folder, "calls", "call", _CALL).collect()  # one row a year
    return xmlrecords.read_calls(spark, f"{folder}/calls-2020.xml").groupBy("number", "date", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT type, count(*) AS n, sum(duration) AS seconds, min(date) AS earliest FROM {TYPED} GROUP BY type")
def xml_stream_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of XML files read as a stream."""
    folder = _folder(spark)
    store.export_years(typed_calls(spark, sf), f"{folder}/in", "calls", "call", _CALL).collect()  # one row a year
    stream = xmlrecords.stream_calls(spark, f"{folder}/in").select("type", "duration", "date")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").cast("decimal(38,0)").alias("seconds"), F.min("date").alias("earliest"))


@query(f"SELECT {YEAR} AS year, count(*) AS n FROM {TYPED} GROUP BY 1")
def input_files_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Input files found below a folder by name, size and place: those of a store (the same files once more) and of other names are left out."""
    folder = _folder(spark)
    calls = typed_calls(spark, sf)
    for place, root in (("in/a", "calls"), ("store/calls", "calls"), ("in/b", "other")):
        store.export_years(calls, f"{folder}/{place}", root, "call", _CALL).collect()  # one row a year
    paths = xmlrecords.input_paths(spark, folder)
    return xmlrecords.read_calls(spark, paths).groupBy(S.utc_year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT sha256('p' || n_nationkey) AS hash, CAST(n_regionkey AS BIGINT) AS size, n_name || '.png' AS file_name, 'image/png' AS mime FROM nation""")
def metadata_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions of attachments (one for each nation) written beside them and read back."""
    folder = _folder(spark)
    n = table(spark, sf, "nation")
    described = n.select(F.sha2(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")), 256).alias("hash"), F.col("n_regionkey").cast("bigint").alias("size"), F.concat("n_name", F.lit(".png")).alias("file_name"), F.lit("image/png").alias("mime"))
    store.write_metadata(described, folder).write.parquet(f"{folder}/written")
    return scan.metadata(spark, folder)
