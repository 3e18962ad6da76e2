"""Near-duplicates of new batches against everything accepted before.

A call is written as a fixed-width text: its number, the 2,001 ms cell of its
start and its duration. Rows that agree in all three are the same call whatever
their exact start, so they are folded before anything else happens; all further
work is on distinct texts.

Each batch becomes an immutable segment in a shared folder: the concatenation of
its texts in the order of a sparse suffix array (the suffixes that begin a record;
no other can match a whole number and cell), divided by the hash of number and
day. For each record of a new batch the substrings "number, cell" of its own and
the two neighbouring cells, continued by the durations that differ by at most two,
are binary-searched in every segment where it lies: tasks read the stored runs of
their own division, and of those the row groups between the first and the last
substring asked for only. Nothing of the history is shuffled or sorted again. What
is matched covers a record's number and cell whole; an exact check of the
milliseconds and of the duration follows, and the matched bytes are added up for
each record as its coverage. When a segment isn't twice as large as the next one
both are merged, so there are logarithmically many of them.

The links of a batch are contracted to stars in the tasks (by hooking and pointer
jumping) and kept beside the segments; classes are the connected components of
all stars, of which only labels that meet in one record have to be joined further.

Defined cases: rows without a usable number or start belong to no class, rows
without a usable duration only to their own (no class of two); ties take the
smaller call_id; exact repetitions are members like any others; a number of more
than MAX_DIGITS digits is compared by its digest; rows without batch_no or call_id
are in no batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.components import connected
from recordloom.session import application_scratch, cut, file_system, read_text, write_text

#: Starts differ by at most this many milliseconds, durations by at most this many seconds.
MAX_MS, MAX_S = 2000, 2
#: Milliseconds of a cell: any two starts in one cell are near enough.
CELL_MS = MAX_MS + 1
#: Cells of a day, by which the records of one number are divided, and how far a search may reach into the next day.
BLOCK_CELLS, MARGIN_CELLS = 43_200, 1
#: Digits that a text has room for.
MAX_DIGITS = 32
#: Bytes of a row group of a stored segment.
ROW_GROUP = 1 << 20


def number_key(number: Column) -> Column:
    """The number without punctuation, country code 1, ``00`` or ``+``; empty if it is no number.

    Each expression is used once, so a filter on it doesn't evaluate it again and again.
    """
    plain = F.regexp_replace(number, r"[^0-9\p{L}]+", "")
    return F.regexp_extract(plain, r"^(?:00)?+(?:1(?=[0-9]{10}$))?+([0-9]{3,})$", 1)


def _bounded(num: Column) -> Column:
    """The number, or its first digits and its digest if it has more digits than a text has room for."""
    return F.when(F.length(num) > MAX_DIGITS, F.concat(F.substring(num, 1, 8), F.sha2(num, 256))).otherwise(num)


def usable_calls(calls: DataFrame, *more: str) -> DataFrame:
    """call_id, num, cell, ms_in, dur of the rows that can be compared, and the columns ``more``."""
    ms = F.trim("date").try_cast("bigint")
    dur = F.trim("duration").try_cast("int")
    return (
        calls.select("call_id", *more, number_key(F.col("number")).alias("num"), ms.alias("ms"), dur.alias("dur"))
        .where("call_id is not null and num <> '' and ms > 0 and dur >= 0")
        .select("call_id", *more, _bounded(F.col("num")).alias("num"), F.expr(f"ms div {CELL_MS}").alias("cell"), (F.col("ms") % CELL_MS).cast("int").alias("ms_in"), "dur")
    )


def folded(usable: DataFrame, *more: str) -> DataFrame:
    """Distinct texts: num, cell, dur, ``more``, lo, hi (milliseconds within the cell), first (smallest call_id), n (rows)."""
    return usable.groupBy("num", "cell", "dur", *more).agg(F.min("ms_in").alias("lo"), F.max("ms_in").alias("hi"), F.min("call_id").alias("first"), F.count(F.lit(1)).alias("n"))


def _be(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def texts_of(num: np.ndarray, cell: np.ndarray, dur: np.ndarray) -> np.ndarray:
    """The texts of some records as one concatenation of fixed-width texts: number, cell (6 bytes), duration (5 bytes, moved by MAX_S + 1 so that it can be stepped below zero)."""
    width = num.dtype.itemsize
    out = np.empty((len(num), width + 11), dtype=np.uint8)
    out[:, :width] = num.view(np.uint8).reshape(len(num), width)
    out[:, width : width + 6] = _be(cell, 6)
    out[:, width + 6 :] = _be(dur + MAX_S + 1, 5)
    return out.view(f"S{width + 11}").ravel()


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _star(node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, label of each): the links contracted to the smallest node of each component."""
    nodes, at = np.unique(np.concatenate([node, other]), return_inverse=True)
    return nodes, nodes[components(len(nodes), at[: len(node)], at[len(node) :])]


class Run:
    """A stored segment's sorted texts of one bucket, read by row groups; the last one read is kept."""

    def __init__(self, fs, path: str, touched=None):
        import pyarrow.parquet as pq

        self.file, self.touched, self.last = pq.ParquetFile(fs.open_input_file(path)), touched, (-1, None)
        names = [self.file.schema_arrow.names.index(c) for c in ("num", "cell")]
        meta = self.file.metadata
        self.bounds = []
        for g in range(meta.num_row_groups):
            num, cell = (meta.row_group(g).column(i).statistics for i in names)
            known = num is not None and num.has_min_max and cell is not None and cell.has_min_max
            # within one number the cells are in order as well
            self.bounds.append(((num.min, cell.min if num.min == num.max else -1), (num.max, cell.max if num.min == num.max else 1 << 62)) if known else None)

    def between(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[dict]:
        """Columns of the row groups that may hold texts between two (number, cell)."""
        for g, bounds in enumerate(self.bounds):
            if bounds is not None and (bounds[1] < low or bounds[0] > high):
                continue
            if self.last[0] != g:
                self.last = (g, _columns(self.file.read_row_group(g)))
                if self.touched is not None:
                    self.touched.add(1)
            yield self.last[1]


def _columns(table) -> dict:
    out = {c: table.column(c).to_numpy() for c in ("cell", "dur", "lo", "hi", "first", "n", "batch_no")}
    out["dur"] = out["dur"].astype(np.int64)
    out["num"] = np.array(table.column("num").to_pylist(), dtype="S") if table.num_rows else np.zeros(0, "S1")
    return out


def _widened(num: np.ndarray, width: int) -> np.ndarray:
    return num if num.dtype.itemsize == width else num.astype(f"S{width}")


def search(asked: dict, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """(asking, held) positions of records of the same call; ``held`` is sorted by text."""
    width = max(asked["num"].dtype.itemsize, held["num"].dtype.itemsize)
    texts = texts_of(_widened(held["num"], width), held["cell"], held["dur"])
    num, cell, dur = _widened(asked["num"], width), asked["cell"], asked["dur"]
    me, other = [], []
    for step in (-1, 0, 1):
        a = np.searchsorted(texts, texts_of(num, cell + step, dur - MAX_S), side="left")
        b = np.searchsorted(texts, texts_of(num, cell + step, dur + MAX_S), side="right")
        size = b - a
        i = np.repeat(np.arange(len(num)), size)
        j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        if step < 0:
            near = asked["lo"][i].astype(np.int64) + CELL_MS - held["hi"][j] <= MAX_MS
        elif step > 0:
            near = held["lo"][j].astype(np.int64) + CELL_MS - asked["hi"][i] <= MAX_MS
        else:
            near = asked["first"][i] != held["first"][j]
        me.append(i[near])
        other.append(j[near])
    return np.concatenate(me), np.concatenate(other)


#: A record that is linked with another one: its text, its smallest call_id, batch, rows and the smallest call_id it was found connected with; ``covered``: the share of its text that the best match covers.
_STARS = "num string, cell bigint, dur int, node bigint, batch_no int, n bigint, label bigint, covered double"


class History:
    """Segments of accepted batches in a folder; a new batch is held against them without reading what it doesn't touch.

    Every batch is written once as a segment (sorted distinct texts, one file for
    each bucket of number and day) and never changed; ``accept`` merges segments of
    similar size into a new one and leaves the list of the valid ones in the folder
    ``_list``, the links of the batch in ``_links``. ``buckets`` is fixed with the
    first batch; more of them make smaller tasks.

    The folder has to be one that pyarrow and Spark both reach by its URI.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, block: int = BLOCK_CELLS, margin: int = MARGIN_CELLS):
        self.spark, self.buckets, self.block, self.margin = spark, buckets or self.BUCKETS, block, max(1, margin)
        fs, at = file_system(spark, path.rstrip("/"))
        self.path = at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
        #: Row groups that searches have read.
        self.touched = spark.sparkContext.accumulator(0)
        self._pending: tuple | None = None

    def _names(self, folder: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def segments(self) -> list[tuple[str, int]]:
        """(name, rows) of the valid segments, oldest first."""
        names = self._names("_list")
        return [tuple(x) for x in json.loads(read_text(self.spark, f"{self.path}/_list/{names[-1]}"))] if names else []

    def _bucket(self, cell: Column) -> Column:
        return F.pmod(F.xxhash64("num", F.floor(cell / self.block)), F.lit(self.buckets)).cast("int")

    def _write(self, records: DataFrame) -> tuple[str, int]:
        """(name, rows) of a new segment."""
        name, counted = f"segment-{uuid.uuid4().hex}", Observation()
        placed = records.observe(counted, F.count(F.lit(1)).alias("rows")).withColumn("bucket", self._bucket(F.col("cell"))).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "num", "cell", "dur")
        placed.select("num", "cell", "dur", "lo", "hi", "first", "n", "batch_no", "bucket").write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name, counted.get["rows"]

    def _read(self, *names: str) -> DataFrame:
        schema = "num string, cell bigint, dur int, lo int, hi int, first bigint, n bigint, batch_no int, bucket int"
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{n}") for n in names])

    def _linked(self, name: str, held: list[str]) -> DataFrame:
        """The stars of the links of the segment ``name`` with those in ``held`` and itself."""
        reach = F.array_distinct(F.array(*[self._bucket(F.col("cell") + d) for d in sorted({-self.margin, -1, 0, 1, self.margin})]))
        asked = self._read(name).withColumn("bucket", F.explode(reach)).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "num", "cell")
        path, names, touched = self.path, [*held, name], self.touched

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            from pyarrow import fs as pafs

            fs, base = pafs.FileSystem.from_uri(path)
            open_bucket, runs = -1, []
            for batch in batches:
                table = pa.Table.from_batches([batch])
                buckets = table.column("bucket").to_numpy()
                starts = np.concatenate([[0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1]) if len(buckets) else []
                for at, start in enumerate(starts):
                    end = starts[at + 1] if at + 1 < len(starts) else len(buckets)
                    if buckets[start] != open_bucket:
                        open_bucket = buckets[start]
                        files = [f.path for n in names for f in fs.get_file_info(pafs.FileSelector(f"{base}/{n}/bucket={open_bucket}", allow_not_found=True)) if f.path.endswith(".parquet")]
                        runs = [Run(fs, f, touched) for f in files]
                    asked = _columns(table.slice(start, end - start))
                    low = (asked["num"][0].decode(), int(asked["cell"][0]) - 1)
                    high = (asked["num"][-1].decode(), int(asked["cell"][-1]) + 1)
                    if len(asked["num"]) and (out := _stars_of(asked, [h for r in runs for h in r.between(low, high)])) is not None:
                        yield out

        def _stars_of(asked: dict, groups: list[dict]):
            import pyarrow as pa

            left, right, rows = [], [], []
            covered = np.zeros(len(asked["num"]), dtype=np.int64)
            width = np.char.str_len(asked["num"])
            for held in groups:
                me, other = search(asked, held)
                if not len(me):
                    continue
                # number and cell are matched whole; the duration is only where it is equal
                np.maximum.at(covered, me, width[me] + 6 + 5 * (asked["dur"][me] == held["dur"][other]))
                left.append(asked["first"][me])
                right.append(held["first"][other])
                far = np.unique(other)
                rows.append([held[c][far] for c in ("num", "cell", "dur", "first", "batch_no", "n")] + [np.zeros(len(far))])
            if not left:
                return None
            near = np.unique(np.flatnonzero(covered))
            rows.append([asked[c][near] for c in ("num", "cell", "dur", "first", "batch_no", "n")] + [covered[near] / (width[near] + 11)])
            nodes, labels = _star(np.concatenate(left), np.concatenate(right))
            num = np.concatenate([r[0].astype(object) for r in rows])
            cell, dur, node, batch, n, share = (np.concatenate([r[i] for r in rows]) for i in range(1, 7))
            # the asking record's own row comes last and is kept
            once = len(node) - 1 - np.unique(node[::-1], return_index=True)[1]
            label = labels[np.searchsorted(nodes, node[once])]
            return pa.RecordBatch.from_arrays(
                [pa.array([x.decode() for x in num[once]], pa.string()), pa.array(cell[once]), pa.array(dur[once].astype(np.int32)), pa.array(node[once]), pa.array(batch[once].astype(np.int32)), pa.array(n[once]), pa.array(label), pa.array(share[once])],
                names=["num", "cell", "dur", "node", "batch_no", "n", "label", "covered"],
            )

        return asked.select("num", "cell", "dur", "lo", "hi", "first", "n", "batch_no", "bucket").mapInArrow(run, _STARS)

    def links(self) -> DataFrame | None:
        """The stars of all accepted batches."""
        names = self._names("_links")
        return self.spark.read.schema(_STARS).parquet(*[f"{self.path}/_links/{n}" for n in names]) if names else None

    def _staged(self, batch: DataFrame, number: int | None) -> tuple[str, int, str]:
        """(segment, its rows, folder of its stars) of a batch, which ``repeats`` and ``accept`` of the same batch share."""
        if self._pending is None or self._pending[0] is not batch:
            number = len(self._names("_links")) if number is None else number
            name, rows = self._write(folded(usable_calls(batch)).withColumn("batch_no", F.lit(number)))
            self._linked(name, [n for n, _ in self.segments()]).write.parquet(f"{self.path}/_staged-{name}")
            self._pending = (batch, name, rows, f"{self.path}/_staged-{name}")
        return self._pending[1:]

    def repeats(self, batch: DataFrame) -> DataFrame:
        """first_call_id, call_id, covered of the rows of ``batch`` (as ``calls``) whose call is in the history."""
        number = len(self._names("_links"))
        stars, before = self.spark.read.schema(_STARS).parquet(self._staged(batch, None)[2]), self.links()
        if before is not None:  # only stars that share a record with the batch's can join its classes
            stars = stars.unionByName(before.join(_reached(before, stars), "label", "left_semi"))
        labels = classes(stars).where(F.col("first_batch") < number).select("num", "cell", "dur", "first_call_id", "covered")
        return usable_calls(batch).join(labels, ["num", "cell", "dur"]).select("first_call_id", "call_id", "covered")

    def accept(self, batch: DataFrame, number: int | None = None) -> None:
        """Adds a batch as a segment with its links and merges segments of similar size; ``number``: its place in the order of batches."""
        name, rows, stars = self._staged(batch, number)
        version = f"{len(self._names('_links')):08d}"
        fs, at = file_system(self.spark, stars)
        fs.mkdirs(file_system(self.spark, f"{self.path}/_links")[1])
        fs.rename(at, file_system(self.spark, f"{self.path}/_links/{version}")[1])
        self._pending = None
        held, newer, size = self.segments(), [name], rows
        while held and held[-1][1] <= 2 * size:
            older, n = held.pop()
            newer, size = [older, *newer], size + n
        if len(newer) > 1:
            merged = self._read(*newer).groupBy("num", "cell", "dur").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.sum("n").alias("n"), F.min("batch_no").alias("batch_no"))
            name, rows = self._write(merged)
        write_text(self.spark, f"{self.path}/_list/{version}", json.dumps([*held, (name, rows)]))
        for n in newer if len(newer) > 1 else ():  # the new list doesn't name them any more
            fs.delete(file_system(self.spark, f"{self.path}/{n}")[1], True)


def _reached(before: DataFrame, stars: DataFrame) -> DataFrame:
    """Labels of ``before`` that are connected with the records or labels of ``stars``."""
    both = before.select("node", "label")
    roots = connected(both.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))).select("node", F.col("label").alias("root"))
    asked = stars.select("node").union(stars.select("label")).distinct()
    hit = roots.join(asked, "node", "left_semi").select("root").distinct()
    members = roots.join(hit, "root", "left_semi").select(F.col("node").alias("label"))
    return members.union(before.where("node = label").select("label").join(asked.select(F.col("node").alias("label")), "label", "left_semi")).distinct()


def classes(stars: DataFrame) -> DataFrame:
    """num, cell, dur, first_call_id, first_batch, last_batch, members, covered of every text of a class of two or more rows.

    Each star is connected already; only labels that meet in one record are joined.
    """
    nodes = stars.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("num", "cell", "dur")], F.min("batch_no").alias("batch_no"), F.max("n").alias("n"), F.max("covered").alias("covered"), F.min("label").alias("label"), F.max("label").alias("high"))
    meeting = nodes.where("label < high").select("node", F.col("label").alias("a")).join(stars.select("node", F.col("label").alias("b")), "node").where("a < b").select("a", "b").distinct()
    joined = nodes
    if not meeting.isEmpty():
        joined = nodes.join(connected(meeting).select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    whole = joined.groupBy("label").agg(F.min("node").alias("first_call_id"), F.min("batch_no").alias("first_batch"), F.max("batch_no").alias("last_batch"), F.sum("n").alias("members"))
    return joined.select("num", "cell", "dur", "label", "covered").join(whole, "label").groupBy("num", "cell", "dur").agg(
        *[F.any_value(c).alias(c) for c in ("first_call_id", "first_batch", "last_batch", "members")], F.max("covered").alias("covered")
    )


def _temporary(spark: SparkSession, block: int = BLOCK_CELLS, margin: int = MARGIN_CELLS) -> History:
    """A history in the application's scratch folder with as many buckets as the session has shuffle partitions."""
    return History(spark, f"{application_scratch(spark)}/{uuid.uuid4().hex}", max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))), block, margin)


def class_labels(usable: DataFrame, by_batch: bool, block: int = BLOCK_CELLS, margin: int = MARGIN_CELLS) -> DataFrame:
    """num, cell, dur, first_call_id, first_batch, last_batch, members of every distinct text whose class has two or more rows.

    ``usable`` comes from ``usable_calls``, with ``batch_no`` if ``by_batch``; all of it is one segment that is searched
    for its own records. The stars are written to the scratch folder.
    """
    records = folded(usable, "batch_no") if by_batch else folded(usable).withColumn("batch_no", F.lit(0))
    history = _temporary(usable.sparkSession, block, margin)
    name, _ = history._write(records)
    linked = classes(cut(history._linked(name, [])))
    # a text that was delivered again and again alone is a class as well
    alone = history._read(name).where("n > 1").select("num", "cell", "dur", F.col("first").alias("first_call_id"), F.col("batch_no").alias("first_batch"), F.col("batch_no").alias("last_batch"), F.col("n").alias("members"))
    rest = alone.join(linked.select("num", "cell", "dur"), ["num", "cell", "dur"], "left_anti")
    return linked.drop("covered").unionByName(rest)


def found(calls: DataFrame) -> DataFrame:
    """first_call_id, call_id of the rows of new batches that repeat a call of the history or of an earlier batch.

    The batches are accepted one by one in their order, each searched against the segments of those before it.
    """
    history = _temporary(calls.sparkSession)
    numbers = sorted(r[0] for r in calls.where("batch_no is not null").select("batch_no").distinct().collect())  # one row a batch
    for k in numbers:
        history.accept(calls.where(F.col("batch_no") == k), k)
    stars = history.links()
    usable = usable_calls(calls.where("batch_no >= 1"), "batch_no")
    if stars is None:
        return usable.select(F.col("call_id").alias("first_call_id"), "call_id").limit(0)
    labels = classes(stars).where("last_batch > first_batch").select("num", "cell", "dur", "first_call_id", "first_batch")
    return usable.select("call_id", "batch_no", "num", "cell", "dur").join(labels, ["num", "cell", "dur"]).where("batch_no > first_batch").select("first_call_id", "call_id")
