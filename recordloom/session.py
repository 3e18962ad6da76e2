"""Session-level helpers: scratch folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only when it has at most this many rows.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins. Only a session on one machine (``local`` master, as in
    tests) may go without it and gets a folder below the user's temporary directory;
    a session with executors on other machines has to name a folder they share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), "recordloom-scratch")
    os.makedirs(local, exist_ok=True)
    return "file://" + local


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any scheme."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver."""
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    fs, at = file_system(spark, path)
    data = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()


def application_scratch(spark: SparkSession) -> str:
    """The application's own folder below the scratch folder; it is deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/recordloom/{spark.sparkContext.applicationId}"
    if path not in _registered:
        fs, at = file_system(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _registered.add(path)
    return path


_registered: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files every executor can read, so the loss of an
    executor costs no recomputation of what was cut. The files go with ``drop_cut``
    or with the end of the application.
    """
    spark = df.sparkSession
    path = f"{application_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files of results of ``cut`` that nothing will read again."""
    for df in frames:
        fs, at = file_system(df.sparkSession, df._scratch_path)
        fs.delete(at, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
