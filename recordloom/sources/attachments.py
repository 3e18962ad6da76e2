"""The attachment folder of a store as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATH = r"attachments/([0-9a-f]{2})/([0-9a-f]{64})(?:/([^/]+))?$"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """hash, folder, file_name (null in the older layout without a folder per hash), size, digest of the content; metadata files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/attachments")
    part = lambda i: F.regexp_extract("path", _PATH, i)
    return files.where(part(2) != "").select(part(2).alias("hash"), part(1).alias("folder"), F.nullif(part(3), F.lit("")).alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest")).where("file_name is null or file_name <> 'metadata.yaml'")


def layout(files: DataFrame) -> DataFrame:
    """hash, layout: ``new`` (a folder with a named file) or ``legacy`` (a file named by its hash)."""
    return files.groupBy("hash").agg(F.when(F.bool_or(F.col("file_name").isNotNull()), "new").otherwise("legacy").alias("layout"))


def faults(files: DataFrame) -> DataFrame:
    """hash, fault: a folder that isn't the beginning of the hash, a content that isn't the hash's."""
    found = F.filter(F.array(F.when(F.col("folder") != F.substring("hash", 1, 2), F.lit("wrong-folder")), F.when(F.col("digest") != F.col("hash"), F.lit("corrupted"))), lambda x: x.isNotNull())
    return files.select("hash", F.explode(found).alias("fault"))


def migration(files: DataFrame, types: DataFrame) -> DataFrame:
    """hash, source, target of the legacy files whose content is whole: where each moves by the name its type gives; types: hash, extension."""
    old = files.where(F.col("file_name").isNull() & (F.col("digest") == F.col("hash"))).join(types, "hash", "left")
    base = F.concat(F.lit("attachments/"), "folder", F.lit("/"), "hash")
    return old.select("hash", base.alias("source"), F.concat(base, F.lit("/attachment."), F.coalesce("extension", F.lit("bin"))).alias("target"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """hash, size, file_name, mime of the descriptions (``metadata.yaml``) beside the attachments; a field that one lacks is null."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.yaml").text(f"{root.rstrip('/')}/attachments", wholetext=True)
    pairs = F.transform(F.filter(F.split("value", r"\r?\n"), lambda line: line.rlike(r"^[a-z_]+:")), lambda line: F.struct(F.regexp_extract(line, r"^([a-z_]+):", 1).alias("key"), F.regexp_extract(line, r"""^[a-z_]+:\s*["']?(.*?)["']?\s*$""", 1).alias("value")))
    fields = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{64})/metadata\.yaml$", 1).alias("hash"), pairs.alias("pairs"))
    value = lambda key: F.get(F.filter("pairs", lambda p: p["key"] == key), F.lit(0))["value"]
    return fields.where("hash <> ''").select("hash", value("size").try_cast("bigint").alias("size"), value("file_name").alias("file_name"), value("mime").alias("mime"))
