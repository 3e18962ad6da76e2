"""The best value of each field among the deliveries of one call.

The deliveries of a call are found as in ``history``. For each field whole values
go before others, then the more trusted device, then the more current value, then
the smaller call_id.

Currency: rows with a time of receipt are ordered by it. For rows without one the
precedence of values is learned from the timestamped rows of the same number: where
one name follows another in them there is a transition, and of two names the one is
later to which there are more transitions from the other than back (of equally many,
the last one counts). That is a partial order of the number's names; its longest
chains give each name its place, and names on a cycle of it are placed by the last
time they were delivered behind all others that the order places. In a call the
timed rows stand at the place of the latest of them, the others at the place of
their name, so a name without time survives if the order puts it behind what was
received last; a name that no timestamped row shows comes first and loses. A readable
date without time of receipt is older than one with it.

Nothing is ever gathered per call: values are aggregated before they are shuffled,
and whether a name is only the beginning of another one is read from its next
neighbour in sorted order, which starts with it if any name does.

Defined cases: null, blank and placeholder names and names that are only a phone
number are not whole; names that end in an ellipsis are cut; a device without
trust comes last; repeated rows are candidates like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.history import class_labels, usable_calls
from recordloom.operators.graphs import levels
from recordloom.session import cut

#: Contact names that stand for nothing.
NAME_PLACEHOLDERS = ("", "-", "--", "?", "(unknown)", "unknown", "unknown caller", "unknown number", "private", "private number", "anonymous", "restricted", "n/a", "na", "nan", "none", "null", "(null)", "no name")
#: A readable date that states the time to the second, with its half of the day or by 24 hours.
WHOLE_READABLE = r"^[A-Za-z]{3,9}\.? [0-9]{1,2}, [0-9]{4},? (?:at )?(?:[0-9]{1,2}:[0-9]{2}:[0-9]{2} [AaPp][Mm]|(?:1[3-9]|2[0-3]|0[0-9]):[0-9]{2}:[0-9]{2})(?: .*)?$|^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}.*$"
#: Readable dates of the epoch's beginning stand for a missing date.
EPOCH_READABLE = r"^(?:Dec(?:ember)? 31, 1969|Jan(?:uary)? 0?1, 1970|1969-12-31|1970-01-01)\b"
_ELLIPSIS = r"(?:\.{2,}|…)\s*$"


def real_name(name: Column) -> Column:
    """The trimmed name without an ellipsis; null for a placeholder or a phone number."""
    text = F.trim(F.regexp_replace(name, _ELLIPSIS, ""))
    nothing = F.lower(text).isin(*NAME_PLACEHOLDERS) | text.rlike(r"^[-+0-9() .#*/]*$")
    return F.when(~nothing, text)


def whole_readable(text: Column) -> Column:
    """Does a readable date state the time to the second, and isn't it a placeholder?"""
    t = F.trim(text)
    return F.coalesce(t.rlike(WHOLE_READABLE) & ~t.rlike(EPOCH_READABLE), F.lit(False))


def _untimed(rows: DataFrame) -> bool:
    """Is there a row without time of receipt? Parquet answers that from the statistics of its row groups where there is none."""
    return not rows.where("received_at is null").isEmpty()


_STEPS = "num string, a string, b string, n bigint, last bigint, pid int, side int"


def transitions(usable: DataFrame) -> DataFrame:
    """num, a, b, n, last: how often name b follows name a in the timestamped rows of a number, and when it last did (microseconds).

    The rows are sorted by ranges of number and time, so one number may fill many
    tasks; the step from the last row of a task to the first of the next is added from their
    edges, of which there are two a task.
    """
    seen = usable.where("received_at is not null").select("num", real_name(F.col("contact_name")).alias("name"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at"), "call_id").where("name is not null")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid, last = TaskContext.get().partitionId(), None

        def rows(num, a, b, n, at, side):
            size = len(num)
            return pa.RecordBatch.from_arrays([pa.array(num, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array([pid] * size, pa.int32()), pa.array([side] * size, pa.int32())], names=["num", "a", "b", "n", "last", "pid", "side"])

        for batch in batches:
            if not batch.num_rows:
                continue
            num, name, at = batch.column(0), batch.column(1), batch.column(2)
            if last is None:
                yield rows([num[0].as_py()], [None], [name[0].as_py()], [0], [at[0].as_py()], 0)
            else:  # the last row of the batch before goes in front
                num, name, at = (pa.concat_arrays([pa.array([x], c.type), c]) for x, c in zip(last, (num, name, at)))
            last = (num[-1].as_py(), name[-1].as_py(), at[-1].as_py())
            step = pc.and_(pc.equal(num[1:], num[:-1]), pc.not_equal(name[1:], name[:-1]))
            table = pa.table({"num": num[1:].filter(step), "a": name[:-1].filter(step), "b": name[1:].filter(step), "at": at[1:].filter(step)})
            if table.num_rows:
                t = table.group_by(["num", "a", "b"], use_threads=False).aggregate([("at", "count"), ("at", "max")])
                yield rows(t["num"].combine_chunks(), t["a"].combine_chunks(), t["b"].combine_chunks(), t["at_count"].combine_chunks(), t["at_max"].combine_chunks(), -1)
        if last is not None:
            yield rows([last[0]], [last[1]], [None], [0], [last[2]], 1)

    found = cut(seen.repartitionByRange("num", "at", "call_id").sortWithinPartitions("num", "at", "call_id").select("num", "name", "at").mapInArrow(run, _STEPS))
    order = Window.orderBy("pid", "side")  # two rows a task
    edges = found.where("side >= 0").withColumn("a", F.lag("a").over(order)).withColumn("before", F.lag("num").over(order))
    between = edges.where("side = 0 and before = num and a <> b").select("num", "a", "b", F.lit(1).cast("bigint").alias("n"), "last")
    return found.where("side = -1").select("num", "a", "b", "n", "last").unionByName(between).groupBy("num", "a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def precedence(steps: DataFrame) -> DataFrame:
    """num, a, b where b is later than a: more transitions lead from a to b than back, or of equally many the last one."""
    back = steps.select("num", F.col("a").alias("b"), F.col("b").alias("a"), F.struct("n", "last").alias("back"))
    return steps.join(back, ["num", "a", "b"], "left").where(F.col("back").isNull() | (F.struct("n", "last") > F.col("back"))).select("num", "a", "b")


def value_places(usable: DataFrame) -> DataFrame:
    """num, name, place (from 1) of the names that timestamped rows of a number show, in the learned order."""
    known = usable.where("received_at is not null").select("num", real_name(F.col("contact_name")).alias("name"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at")).where("name is not null")
    known = cut(known.groupBy("num", "name").agg(F.max("at").alias("last_seen")))
    node = lambda name: F.concat("num", F.lit("\x1f"), name)
    edges = precedence(transitions(usable)).select(node("b").alias("node"), node("a").alias("needs"))
    placed = levels(edges.unionByName(known.select(node("name").alias("node"), F.lit(None).cast("string").alias("needs"))))
    both = known.withColumn("node", node("name")).join(placed, "node", "left")
    top = both.groupBy("num").agg(F.coalesce(F.max("level"), F.lit(-1)).alias("top"))
    # names on a cycle, and those behind one, by the last time each was delivered
    rest = both.where("level is null").select("num", "name", F.dense_rank().over(Window.partitionBy("num").orderBy("last_seen")).alias("nth")).join(top, "num").select("num", "name", (F.col("top") + F.col("nth")).alias("level"))
    return both.where("level is not null").select("num", "name", "level").unionByName(rest).select("num", "name", (F.col("level") + 1).alias("place"))


def survivors(calls: DataFrame, devices: DataFrame) -> DataFrame:
    """first_call_id, name_call_id, readable_call_id of every call with two or more rows and a whole contact_name."""
    usable = usable_calls(calls, "device_id", "received_at", "contact_name", "readable_date")
    labels = class_labels(usable.select("call_id", "num", "cell", "ms_in", "dur"), by_batch=False).select("num", "cell", "dur", "first_call_id")
    trust = devices.select("device_id", F.col("trust").cast("int").alias("trust")).groupBy("device_id").agg(F.max("trust").alias("trust"))
    rows = (
        usable.join(labels, ["num", "cell", "dur"])
        .select(
            "first_call_id", "call_id", "device_id", "received_at", "num",
            real_name(F.col("contact_name")).alias("name"),
            F.coalesce(F.trim("contact_name").rlike(_ELLIPSIS), F.lit(False)).alias("ends_cut"),
            whole_readable(F.col("readable_date")).alias("readable_whole"),
        )
        .join(trust, "device_id", "left")
        .withColumn("trust", F.coalesce("trust", F.lit(0)))
    )
    if _untimed(calls):
        lacking = rows.where("received_at is null").select("first_call_id", "num").distinct()
        asked = usable.join(lacking.select("num").distinct(), "num", "left_semi")
        rows = rows.join(value_places(asked), ["num", "name"], "left").join(lacking.select("first_call_id", F.lit(True).alias("lacks")).distinct(), "first_call_id", "left")
        # the timed rows of a call and trust stand where the latest of them stands
        timed = rows.where("lacks and received_at is not null").groupBy("first_call_id", "trust").agg(F.max_by(F.coalesce("place", F.lit(0)), F.struct("received_at", -F.col("call_id"))).alias("timed_place"))
        rows = rows.join(timed, ["first_call_id", "trust"], "left")
        place = F.when(F.col("lacks") & F.col("received_at").isNotNull(), F.col("timed_place")).when(F.col("lacks"), F.coalesce("place", F.lit(0))).otherwise(F.lit(0))
    else:
        place = F.lit(0)
    at = F.coalesce(F.col("received_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("at")
    rank = F.struct("trust", place.cast("long").alias("place"), at, (-F.col("call_id")).alias("minus_id"))
    by_time = F.struct("trust", at, (-F.col("call_id")).alias("minus_id"))
    ranked = rows.select("first_call_id", "name", "ends_cut", rank.alias("rank"), F.struct(F.col("readable_whole").alias("whole"), by_time.alias("rank")).alias("readable"))
    # one row per call and name: the best row that writes the name without an ellipsis, and the best readable date beside it
    names = ranked.groupBy("first_call_id", "name").agg(F.max(F.when(~F.col("ends_cut"), F.col("rank"))).alias("best"), F.max("readable").alias("readable"))
    following = F.lead("name").over(Window.partitionBy("first_call_id").orderBy(F.col("name").asc_nulls_first()))
    cut_off = F.coalesce(following.startswith(F.col("name")), F.lit(False))
    judged = names.withColumn("whole_best", F.when(F.col("name").isNotNull() & ~cut_off, F.col("best")))
    calls_ = judged.groupBy("first_call_id").agg(F.max("whole_best").alias("best"), F.max("readable").alias("readable"))
    return calls_.where("best is not null").select(
        F.col("first_call_id"), (-F.col("best.minus_id")).alias("name_call_id"), (-F.col("readable.rank.minus_id")).alias("readable_call_id")
    )
