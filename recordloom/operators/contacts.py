"""Contacts: lookup by number, names without contact, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.scalars import is_phone_text, is_unknown, normalize_phone


def number_lookup(contacts: DataFrame) -> DataFrame:
    """number_key, contact_name: one row per number; of several contacts the smallest contact_id."""
    flat = contacts.select("contact_id", "name", F.explode("numbers").alias("number")).withColumn("number_key", normalize_phone("number")).where("number_key <> ''")
    return flat.groupBy("number_key").agg(F.min_by("name", "contact_id").alias("contact_name"))


def resolve_names(records: DataFrame, contacts: DataFrame, number: str = "number", name: str = "contact_name") -> DataFrame:
    """Overwrites ``name`` with the contact's name where the number is known.

    A plain equi-join: Spark broadcasts the lookup when its size allows it and splits
    a hot number otherwise.
    """
    lookup = number_lookup(contacts).select(F.col("number_key"), F.col("contact_name").alias("known_name"))
    keyed = records.withColumn("number_key", normalize_phone(number))
    return keyed.join(lookup, "number_key", "left").withColumn(name, F.coalesce("known_name", name)).drop("known_name")


def unprocessed_names(records: DataFrame, contacts: DataFrame, trim: bool = True) -> DataFrame:
    """number_key, names: sorted distinct names, split at commas, of numbers that no contact has; placeholders only where there is no real name.

    Distinct names are made before the array, so a hot number costs its distinct names.
    """
    pieces = F.split("contact_name", ",")
    pieces = F.transform(pieces, lambda x: F.trim(x)) if trim else pieces
    flat = records.select(normalize_phone("number").alias("number_key"), F.explode(pieces).alias("name")).where("number_key <> '' and name is not null").distinct()
    unknown = flat.join(number_lookup(contacts).select("number_key"), "number_key", "left_anti")
    named = unknown.withColumn("real", ~is_unknown("name"))
    return named.groupBy("number_key").agg(
        F.when(F.bool_or("real"), F.array_sort(F.collect_set(F.when(F.col("real"), F.col("name"))))).otherwise(F.array_sort(F.collect_set("name"))).alias("names")
    )


def paired_addresses(records: DataFrame, address: str = "address", names: str = "names", trim: bool = True) -> DataFrame:
    """id, pos, address, name of messages to several addresses (split at ``~``) with as many names (split at commas)."""
    a, n = F.split(address, "~"), F.split(names, ",")
    n = F.transform(n, lambda x: F.trim(x)) if trim else n
    zipped = F.arrays_zip(a.alias("address"), n.alias("name"))
    return records.where(F.size(a) == F.size(n)).select("id", F.posexplode(zipped).alias("pos", "pair")).select("id", "pos", F.col("pair.address").alias("address"), F.col("pair.name").alias("name"))


def number_conflicts(contacts: DataFrame) -> DataFrame:
    """number_key, owners: numbers that contacts of different names own."""
    flat = contacts.select("name", F.explode("numbers").alias("number")).select(normalize_phone("number").alias("number_key"), "name").where("number_key <> ''")
    return flat.groupBy("number_key").agg(F.count_distinct("name").alias("owners")).where("owners > 1")


def contact_faults(contacts: DataFrame) -> DataFrame:
    """contact_id, fault: empty or repeated name, no numbers, a number of the wrong form, a number used before."""
    # contacts without a name are groups of their own, so they don't meet in one task
    seen_name = F.row_number().over(Window.partitionBy("name", F.when(F.col("name").isNull(), F.col("contact_id"))).orderBy("contact_id"))
    base = contacts.withColumn("nth", seen_name)
    row_faults = base.select("contact_id", F.explode(F.filter(F.array(
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("empty-name")), F.when((F.col("nth") > 1) & F.col("name").isNotNull(), F.lit("duplicate-name")),
        F.when(F.coalesce(F.size("numbers"), F.lit(0)) <= 0, F.lit("no-numbers")),
    ), lambda x: x.isNotNull())).alias("fault"))
    flat = contacts.select("contact_id", F.posexplode("numbers").alias("pos", "number"))
    again = F.row_number().over(Window.partitionBy("number").orderBy("contact_id", "pos"))
    number_faults = flat.withColumn("nth", again).select("contact_id", F.explode(F.filter(F.array(
        F.when(~is_phone_text("number"), F.lit("bad-number")), F.when(F.col("nth") > 1, F.lit("duplicate-number")),
    ), lambda x: x.isNotNull())).alias("fault"))
    return row_faults.unionByName(number_faults)


def unreferenced_names(names: DataFrame, contacts: DataFrame) -> DataFrame:
    """name, severity: distinct names without a contact; an error if there are contacts at all, else a warning."""
    any_contact = contacts.limit(1).agg((F.count(F.lit(1)) > 0).alias("any"))
    missing = names.where("name is not null").distinct().join(contacts.select("name").distinct(), "name", "left_anti")
    return missing.crossJoin(F.broadcast(any_contact)).select("name", F.when(F.col("any"), "error").otherwise("warning").alias("severity"))  # one row
