"""Chains, bounded histories, changes between scans, rates and renderings of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import cut


def inheritance(edges: DataFrame) -> DataFrame:
    """node, chain (from the root to the node; null on or behind a cycle); edges: node, parent (null for a root; a node has one parent).

    Chains grow by one node a round from the roots; what no round reaches hangs on a cycle
    or on a parent that isn't there.
    """
    edges = cut(edges.where("node is not null").select("node", "parent").distinct())
    reached = cut(edges.where("parent is null").select("node", F.array("node").alias("chain")))
    parts, new = [reached], reached
    while not new.isEmpty():
        new = cut(edges.join(new.select(F.col("node").alias("parent"), "chain"), "parent").select("node", F.array_append("chain", F.col("node")).alias("chain")))
        parts.append(new)
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return edges.select("node").distinct().join(done, "node", "left")


def last_of_each(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key by ``order``: a bounded history. Spark drops the rest before it shuffles (group limit of windows)."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change of files between two scans (path, mtime): ``new``, ``changed``, ``same``, ``removed``."""
    b, n = before.select("path", F.col("mtime").alias("old")), now.select("path", F.col("mtime").alias("fresh"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("fresh").isNull(), "removed").when(F.col("old") != F.col("fresh"), "changed").otherwise("same")
    return b.join(n, "path", "full_outer").select("path", change.alias("change"))


def rate(part: Column, whole: Column) -> Column:
    """A share in percent with two decimals; null of nothing."""
    return F.round(F.try_divide(part * 100.0, whole), 2)


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences and lines of a text with more than ``least`` characters, in order."""
    return F.filter(F.transform(F.split(text, r"[.!?]\s+|\n"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def record_ids(text: Column) -> Column:
    """Ids such as ``ABC-12`` that a text mentions, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2,}-[0-9]+)\b"), F.lit(1)))


def inline_calls(text: Column) -> Column:
    """Names that a text writes with round brackets right behind them, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))))


def report_line(kind: Column, severity: Column, file: Column, message: Column) -> Column:
    """A violation as a line of text."""
    return F.concat(F.lit("["), F.upper(severity), F.lit("] "), kind, F.lit(": "), F.coalesce(file, F.lit("-")), F.when(F.coalesce(message, F.lit("")) != "", F.concat(F.lit(" - "), message)).otherwise(""))


def expiry(until: Column, now: Column, soon: str = "5 minutes") -> Column:
    """``expired``, ``soon`` or ``valid`` by a time of expiry; ``unknown`` where there is none."""
    return F.when(until.isNull(), "unknown").when(until <= now, "expired").when(until <= now + F.expr(f"interval {soon}"), "soon").otherwise("valid")


def normalized_signature(text: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends or around signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r" ?([(),:;#-]) ?", "$1"))
