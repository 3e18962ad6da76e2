"""Call and message backups in XML.

All attributes are read as texts under an explicit schema (inference would drop
``+`` and leading zeros); casts and null rules follow as expressions. Files are
read by record, so a file is split over tasks; ``*_with_position`` reads the root
instead where the order in the file or the declared count matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from recordloom.functions.scalars import null_text, strict_int

#: Attributes of the records, in the order of the format.
CALL = ("number", "duration", "date", "type", "readable_date", "contact_name")
SMS = ("protocol", "address", "date", "type", "subject", "body", "toa", "sc_toa", "service_center", "read", "status", "locked", "date_sent", "readable_date", "contact_name")
MMS = tuple(
    "date msg_box address m_type m_id thread_id text_only sub readable_date contact_name callback_set retr_st ct_cls sub_cs read ct_l tr_id st m_cls d_tm read_status ct_t retr_txt_cs "
    "deletable d_rpt date_sent seen reserved v exp pri hidden msg_id rr app_id resp_txt rpt_a locked retr_txt resp_st m_size sim_imsi creator sub_id sim_slot spam_report safe_message".split()
)
PART = ("seq", "ct", "name", "chset", "cd", "fn", "cid", "cl", "ctt_s", "ctt_t", "text", "data", "path", "original_size", "extraction_date")
ADDR = ("address", "type", "charset")
#: Texts whose ``null`` is kept as written.
LITERAL_NULL = ("protocol", "address", "body", "contact_name", "m_id", "readable_date")
LONGS, FLAGS = ("date", "date_sent", "d_tm", "exp"), ("text_only", "deletable", "seen", "hidden", "locked", "read")
INTS = ("type", "status", "msg_box", "m_type", "thread_id", "retr_st", "sub_cs", "st", "read_status", "retr_txt_cs", "d_rpt", "reserved", "v", "pri", "msg_id", "rr", "app_id", "rpt_a", "resp_st", "m_size", "sub_id", "sim_slot", "spam_report", "safe_message", "callback_set")


def _attributes(names: tuple[str, ...]) -> list[StructField]:
    return [StructField(f"_{n}", StringType()) for n in names]


_PART_TYPE = StructType(_attributes(PART))
_ADDR_TYPE = StructType(_attributes(ADDR))
CALL_SCHEMA, SMS_SCHEMA = StructType(_attributes(CALL)), StructType(_attributes(SMS))
MMS_SCHEMA = StructType([*_attributes(MMS), StructField("parts", StructType([StructField("part", ArrayType(_PART_TYPE))])), StructField("addrs", StructType([StructField("addr", ArrayType(_ADDR_TYPE))]))])


def _read(spark: SparkSession, path: str | list[str], tag: str, schema: StructType) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("nullValue", "\x00").option("ignoreSurroundingSpaces", "false")
    any_value = F.coalesce(*[F.col(f.name).cast("string") if isinstance(f.dataType, StringType) else F.when(F.col(f.name).isNotNull(), F.lit("")) for f in schema.fields])
    return reader.schema(schema).load(path).where(any_value.isNotNull())  # a record that isn't XML has no values


def _value(kind: str, name: str) -> Column:
    """A typed attribute: whole numbers (absent, ``null`` and empty are 0), flags, texts."""
    raw = F.col(f"_{name}")
    if name in LONGS:
        return F.coalesce(strict_int(null_text(raw), "bigint"), F.lit(0).cast("bigint")).alias(name)
    if name in FLAGS:
        return F.coalesce((raw == "1").cast("int"), F.lit(0)).alias(name)
    if name in INTS:
        return F.coalesce(strict_int(null_text(raw)), F.lit(0)).alias(name)
    return (raw if name in LITERAL_NULL else null_text(raw)).alias(name)


def call_columns() -> list[Column]:
    """Typed columns of a call; texts that aren't whole numbers are null and named in ``parse_errors``."""
    errors = F.filter(F.array(*[F.when(F.col(f"_{n}").isNotNull() & strict_int(f"_{n}", k).isNull(), F.lit(f"parse-error: {n}")) for n, k in (("duration", "int"), ("date", "bigint"), ("type", "int"))]), lambda x: x.isNotNull())
    return [F.col("_number").alias("number"), strict_int("_duration").alias("duration"), strict_int("_date", "bigint").alias("date"), strict_int("_type").alias("type"),
            F.col("_readable_date").alias("readable_date"), F.col("_contact_name").alias("contact_name"), errors.alias("parse_errors")]


def read_calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed calls of one file, several files, a folder or a glob, with ``file`` and ``parse_errors``; records that aren't XML are left to ``corrupt_records``."""
    return _read(spark, path, "call", CALL_SCHEMA).select(*call_columns(), F.col("_metadata.file_name").alias("file"))


def read_calls_with_position(spark: SparkSession, path: str) -> DataFrame:
    """Calls with ``file``, ``pos`` (from 0) and the ``declared`` count of their file; one row of the scan is one file."""
    root = StructType([StructField("_count", StringType()), StructField("call", ArrayType(CALL_SCHEMA))])
    files = _read(spark, path, "calls", root).select(F.col("_metadata.file_name").alias("file"), strict_int("_count").alias("declared"), F.posexplode("call").alias("pos", "c"))
    return files.select("file", "declared", "pos", "c.*").select("file", "declared", "pos", *call_columns())


def stream_calls(spark: SparkSession, path: str) -> DataFrame:
    """Typed calls of the files of a folder as a stream: each file is read once, record by record."""
    reader = spark.readStream.format("xml").option("rowTag", "call").option("mode", "PERMISSIVE").option("nullValue", "\x00").option("ignoreSurroundingSpaces", "false")
    return reader.schema(CALL_SCHEMA).load(path).where(F.coalesce(*[F.col(f.name) for f in CALL_SCHEMA.fields]).isNotNull()).select(*call_columns())


def input_paths(spark: SparkSession, root: str, kind: str = "all", most: int = 500 * 1024 * 1024) -> list[str]:
    """Paths of the files below a folder to import: by name, size and place (one row a file)."""
    from recordloom.operators.validation import wanted_inputs

    return sorted(r[0] for r in wanted_inputs(small_files(spark, root, most), kind).select("path").collect())


def declared_counts(spark: SparkSession, path: str, root: str) -> DataFrame:
    """file, declared: the count that each file states."""
    return _read(spark, path, root, StructType([StructField("_count", StringType())])).select(F.col("_metadata.file_name").alias("file"), strict_int("_count").alias("declared"))


def read_sms(spark: SparkSession, path: str) -> DataFrame:
    """Typed short messages, kind ``sms``."""
    return _read(spark, path, "sms", SMS_SCHEMA).select(F.lit("sms").alias("kind"), *[_value("sms", n) for n in SMS], F.col("_metadata.file_name").alias("file"))


def read_mms(spark: SparkSession, path: str) -> DataFrame:
    """Typed picture messages with arrays of parts and addresses, kind ``mms``; the type is 1 for received ones, else 2."""
    part = lambda p: F.struct(
        *[F.coalesce(strict_int(null_text(p[f"_{n}"]), "bigint" if n == "original_size" else "int"), F.lit(0)).alias(n) if n in ("seq", "original_size") else (p[f"_{n}"] if n in ("ct", "text") else null_text(p[f"_{n}"])).alias(n) for n in PART]
    )
    addr = lambda a: F.struct(a["_address"].alias("address"), strict_int(null_text(a["_type"])).alias("type"), strict_int(null_text(a["_charset"])).alias("charset"))
    empty = lambda c: F.coalesce(c, F.array())
    raw = _read(spark, path, "mms", MMS_SCHEMA)
    return raw.select(
        F.lit("mms").alias("kind"), *[_value("mms", n) for n in MMS], F.when(F.col("_msg_box") == "1", 1).otherwise(2).alias("type"),
        empty(F.transform("parts.part", part)).alias("parts"), empty(F.transform("addrs.addr", addr)).alias("addrs"), F.col("_metadata.file_name").alias("file"),
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Both kinds of messages; columns that a kind lacks are null."""
    return read_sms(spark, path).unionByName(read_mms(spark, path), allowMissingColumns=True)


def corrupt_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """file, record: lines that begin a record of a tag and don't end it. External entities are never resolved."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))
    return lines.where(F.col("record").rlike(rf"<{tag}\b") & ~F.col("record").rlike(rf"<{tag}\b[^<]*(/>|>\s*(</{tag}>|$))"))


def small_files(spark: SparkSession, path: str, most: int = 500 * 1024 * 1024) -> DataFrame:
    """path, size of the files that are not above the size limit, hidden ones left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")).where(F.col("length") <= most)


def file_years(files: DataFrame, kind: str) -> DataFrame:
    """year: years of the files named ``kind-YYYY.xml``, in order."""
    return files.select(F.regexp_extract("path", rf"(?:^|/){kind}-([0-9]{{4}})\.xml$", 1).alias("y")).where("y <> ''").select(F.col("y").cast("int").alias("year")).distinct().orderBy("year")
