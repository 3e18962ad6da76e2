"""The canonical store: Parquet by entity and year, refused rows, attachments, manifest, exports."""

from __future__ import annotations

import hashlib
import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import file_system
from recordloom.sources import yamlfiles


def write_years(records: DataFrame, path: str, entity: str, ms: str = "date") -> None:
    """Rewrites the years of an entity that ``records`` holds, each sorted by time, and leaves the others.

    Rows go to a year's writers by range of time, so a year that holds most rows is
    written by many tasks, and files are ordered by time for pruning.
    """
    spark = records.sparkSession
    rows = records.withColumn("entity", F.lit(entity)).withColumn("year", F.year(F.timestamp_millis(ms)))
    ordered = rows.repartitionByRange("year", ms).sortWithinPartitions("year", ms)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        ordered.write.mode("overwrite").partitionBy("entity", "year").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_store(spark: SparkSession, path: str, entity: str | None = None, year: int | None = None) -> DataFrame:
    """The store; entity and year prune its folders."""
    df = spark.read.parquet(path)
    if entity is not None:
        df = df.where(F.col("entity") == entity)
    return df if year is None else df.where(F.col("year") == year)


def write_refused(refused: DataFrame, path: str, source: str) -> None:
    """Appends refused rows with their violations as JSON lines, in a folder for their source."""
    refused.select(F.lit(source).alias("source"), F.to_json(F.struct(*[c for c in refused.columns if c != "violations"])).alias("data"), "violations").write.mode("append").partitionBy("source").json(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, which tasks hand to pyarrow."""
    fs, at = file_system(spark, path)
    return at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def write_attachments(contents: DataFrame, folder: str) -> DataFrame:
    """Writes contents (hash, content binary) below their addresses; hash and state ``written``, ``present`` or ``corrupt``.

    Contents are written by the tasks that read them, without a shuffle. Each file is written to
    a temporary name and renamed after its hash was checked, so a task that runs again and a
    content that comes twice change nothing. ``folder`` must be on a file system that all
    executors share and pyarrow reaches by its URI.
    """
    root = qualified(contents.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            states = []
            for digest, content in zip(batch["hash"], batch["content"]):
                target = f"{base}/attachments/{digest[:2]}/{digest}"
                if content is None or hashlib.sha256(content).hexdigest() != digest:
                    states.append("corrupt")
                elif fs.get_file_info(target).type != pafs.FileType.NotFound:
                    states.append("present")
                else:
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    name = f"{target}.{uuid.uuid4().hex}.tmp"
                    with fs.open_output_stream(name) as f:
                        f.write(content)
                    fs.move(name, target)
                    states.append("written")
            yield pd.DataFrame({"hash": batch["hash"], "state": states})

    done = contents.where("hash is not null").select("hash", "content").mapInPandas(run, "hash string, state string")
    return done.groupBy("hash").agg(F.max("state").alias("state"))  # written before present


def write_metadata(described: DataFrame, folder: str) -> DataFrame:
    """Writes a description (hash, size, file_name, mime) beside each attachment, under a temporary name that is renamed; hash, file."""
    root = qualified(described.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import uuid

        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            files = []
            for digest, size, name, mime in batch.itertuples(index=False, name=None):
                place = f"{base}/attachments/{digest[:2]}/{digest}"
                fs.create_dir(place, recursive=True)
                temporary = f"{place}/.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temporary) as f:
                    f.write(f"hash: {digest}\nsize: {size}\nfile_name: {json.dumps(name, ensure_ascii=False)}\nmime: {mime}\n".encode())
                fs.move(temporary, f"{place}/metadata.yaml")
                files.append(f"attachments/{digest[:2]}/{digest}/metadata.yaml")
            yield pd.DataFrame({"hash": batch["hash"], "file": files})

    return described.select("hash", "size", "file_name", "mime").mapInPandas(run, "hash string, file string")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, checksum (``sha256:`` and hexadecimal digits) of all files of a folder but hidden, temporary and refused ones."""
    from recordloom.operators.integrity import files_to_skip

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    rows = files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.col("length").alias("size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"))
    return rows.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), "size", "checksum").where(~files_to_skip("name") & ~F.col("name").isin("files.yaml", "files.yaml.sha256"))


def write_manifest(spark: SparkSession, folder: str, generated: str) -> str:
    """Writes ``files.yaml`` and its checksum; the text of the manifest."""
    rows = manifest(spark, folder).orderBy("name").collect()
    text = yamlfiles.dump({"version": "1.0", "generated": generated, "generator": "recordloom", "files": [r.asDict() for r in rows]})
    with open(f"{folder}/files.yaml", "w", encoding="utf-8") as f:
        f.write(text)
    with open(f"{folder}/files.yaml.sha256", "w", encoding="utf-8") as f:
        f.write(f"{hashlib.sha256(text.encode()).hexdigest()}  files.yaml")
    return text


def element(tag: str, columns: list[str]):
    """A record as an XML element: an expression that leaves out null attributes."""
    escaped = lambda c: F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;"), "\n", " ")
    return F.concat(F.lit(f"<{tag} "), F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"'))) for c in columns]), F.lit(" />"))


def export_year(records: DataFrame, target: str, root: str, tag: str, columns: list[str], order: list[str]) -> int:
    """One XML file with the declared count and the records in order; the number of records.

    Records are rendered by tasks and streamed to the file partition by partition, so
    the driver holds one partition at a time.
    """
    ordered = records.orderBy(*order).select(element(tag, columns).alias("line"))
    n = records.count()
    with open(target, "w", encoding="utf-8") as f:
        f.write(f"<?xml version='1.0' encoding='UTF-8' standalone='yes' ?>\n<{root} count=\"{n}\">\n")
        for row in ordered.toLocalIterator():
            f.write(f"  {row[0]}\n")
        f.write(f"</{root}>\n")
    return n


def export_years(records: DataFrame, folder: str, root: str, tag: str, columns: list[str], ms: str = "date") -> DataFrame:
    """One XML file a year (``root-YYYY.xml``) with its declared count and its records by time; year, n, file.

    A task renders and writes the whole years it has, record by record, under a temporary name that is
    renamed at the end; nothing passes through the driver.
    """
    target = qualified(records.sparkSession, folder)
    lines = records.select(F.year(F.timestamp_millis(ms)).alias("year"), F.col(ms).alias("at"), element(tag, columns).alias("line"))
    counts = lines.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    placed = lines.join(counts, "year").repartition("year").sortWithinPartitions("year", "at", "line").select("year", "n", "line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        open_year, out, temporary, rows = None, None, "", 0
        done: list[tuple[int, int, str]] = []

        def close() -> None:
            if out is not None:
                out.write(f"</{root}>\n".encode())
                out.close()
                name = f"{root}-{open_year}.xml"
                fs.move(temporary, f"{base}/{name}")
                done.append((open_year, rows, name))

        for batch in batches:
            for year, n, line in zip(batch["year"].tolist(), batch["n"].tolist(), batch["line"]):
                if year != open_year:
                    close()
                    open_year, rows, temporary = year, n, f"{base}/.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temporary)
                    out.write(f"<?xml version='1.0' encoding='UTF-8' standalone='yes' ?>\n<{root} count=\"{n}\">\n".encode())
                out.write(f"  {line}\n".encode())
        close()
        yield pd.DataFrame(done, columns=["year", "n", "file"]).astype({"year": "int32", "n": "int64"})

    return placed.mapInPandas(run, "year int, n bigint, file string")


def html_table(rows: list[dict], columns: list[str]) -> str:
    """A small table as HTML."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"
