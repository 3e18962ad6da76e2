"""Keyed first-wins coalescing of an existing store and incoming batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_key() -> Column:
    """SHA-256 of number, duration, date and type; the readable date and the name don't count."""
    return F.sha2(F.concat(F.lit("number:"), F.coalesce("number", F.lit("")), F.lit("|duration:"), F.col("duration").cast("string"), F.lit("|date:"), F.col("date").cast("string"), F.lit("|type:"), F.col("type").cast("string"), F.lit("|")), 256)


#: The fields of the key of a short message and of a picture message behind address, date and type.
SMS_KEY_FIELDS = ("body", "protocol", "subject", "service_center", "read", "status", "locked", "date_sent")
MMS_KEY_FIELDS = ("msg_box", "m_id", "m_type")
#: Numeric fields, which count as 0 where they are missing.
_NUMERIC = ("read", "status", "locked", "date_sent", "msg_box", "m_type", "seq", "type", "charset")


def _said(name: str, value: Column, label: Column | None = None) -> Column:
    """``name:value|``."""
    text = F.coalesce(value.cast("string"), F.lit("0" if name in _NUMERIC else ""))
    return F.concat(F.lit(name) if label is None else label, F.lit(":"), text, F.lit("|"))


def message_key(messages: DataFrame | None = None, mode: str = "full") -> Column:
    """SHA-256 of a message: address, date and type, and in full mode all that identifies it.

    For a short message (kind ``sms``) these are SMS_KEY_FIELDS, for a picture message
    (``mms``) MMS_KEY_FIELDS, every part (seq, ct, name, text, and its path, or that it has data) and
    every address (address, type, charset) in their order. The readable date and the
    contact's name don't count. ``messages`` tells which columns there are; a field
    that it lacks counts as missing. Null texts equal empty ones, null numbers 0.
    """
    there = {f.name: f.dataType for f in messages.schema} if messages is not None else {}
    field = lambda name: F.col(name) if name in there else F.lit(None).cast("string")
    base = F.concat(F.lit("address:"), F.coalesce("address", F.lit("")), F.lit("|date:"), F.col("date").cast("string"), F.lit("|type:"), F.col("type").cast("string"), F.lit("|"))
    if mode != "full":
        return F.sha2(base, 256)
    sms = F.concat(F.lit("msgtype:sms|"), *[_said(f, field(f)) for f in SMS_KEY_FIELDS])
    mms = F.concat(F.lit("msgtype:mms|"), *[_said(f, field(f)) for f in MMS_KEY_FIELDS], _each(there, "parts", _part), _each(there, "addrs", _address))
    return F.sha2(F.concat(base, F.when(F.col("kind") == "sms", sms).when(F.col("kind") == "mms", mms).otherwise(F.concat(F.lit("msgtype:"), F.coalesce("kind", F.lit("")), F.lit("|")))), 256)


def _each(there: dict, array: str, how) -> Column:
    if array not in there:
        return F.lit("")
    fields = set(there[array].elementType.names)
    return F.coalesce(F.array_join(F.transform(array, lambda x, i: how(x, i.cast("string"), fields)), ""), F.lit(""))


def _part(p: Column, i: Column, fields: set[str]) -> Column:
    field = lambda name: p[name] if name in fields else F.lit(None).cast("string")
    label = lambda name: F.concat(F.lit("part"), i, F.lit("_" + name))
    path = F.coalesce(field("path"), F.lit(""))
    held = F.when(path != "", _said("path", path, label("path"))).when(F.coalesce(field("data").cast("string"), F.lit("")) != "", F.concat(label("has_data"), F.lit(":true|"))).otherwise("")
    return F.concat(*[_said(f, field(f), label(f)) for f in ("seq", "ct", "name", "text")], held)


def _address(a: Column, i: Column, fields: set[str]) -> Column:
    return F.concat(*[_said(f, a[f] if f in fields else F.lit(None).cast("string"), F.concat(F.lit("addr"), i, F.lit("_" + f))) for f in ("address", "type", "charset")])


def first_wins(records: DataFrame, key: Column, *order: Column) -> DataFrame:
    """Adds ``key`` and ``rn``, the place of each row among those of its key; ``order`` decides, so the result is the same on every run.

    One shuffle on the key. Rows with a null key form one group.
    """
    return records.withColumn("key", key).withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order)))


def coalesce(existing: DataFrame, incoming: DataFrame, key: Column, *order: Column) -> DataFrame:
    """Existing rows first, then the incoming in order: src (0, 1), key, rn."""
    both = existing.withColumn("src", F.lit(0)).unionByName(incoming.withColumn("src", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, key, F.col("src"), *order)


def survivors(existing: DataFrame, incoming: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key without keeping a rank: a map-side minimum instead of a window sort.

    Rows are compared by (src, order); equal rows are taken once. Hot keys are reduced
    before the shuffle.
    """
    both = existing.withColumn("src", F.lit(0)).unionByName(incoming.withColumn("src", F.lit(1)), allowMissingColumns=True).withColumn("key", key)
    columns = [c for c in both.columns if c != "key"]
    best = both.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct("src", *order)).alias("r"))
    return best.select("key", "r.*")


def new_only(existing: DataFrame, incoming: DataFrame, key: Column) -> DataFrame:
    """Incoming rows whose key the store doesn't hold."""
    return incoming.withColumn("key", key).join(existing.select(key.alias("key")).distinct(), "key", "left_anti")


def coalesce_statistics(ranked: DataFrame, *by: str) -> DataFrame:
    """initial, added, duplicates, final and the raw initial count, by columns (none: one row)."""
    src, first = F.col("src"), F.col("rn") == 1
    aggregates = [
        F.count_if((src == 0) & first).alias("initial"), F.count_if((src == 1) & first).alias("added"),
        F.count_if((src == 1) & ~first).alias("duplicates"), F.count_if(first).alias("final"), F.count_if(src == 0).alias("initial_rows"),
    ]
    return ranked.groupBy(*by).agg(*aggregates) if by else ranked.agg(*aggregates)
