"""Aggregates over a store and over reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_year(records: DataFrame, ms: str = "date") -> DataFrame:
    """year, n, earliest, latest, and a total row with year null."""
    return records.withColumn("year", F.year(F.timestamp_millis(ms))).rollup("year").agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("earliest"), F.max(ms).alias("latest"))


def kinds_per_year(messages: DataFrame) -> DataFrame:
    """year, total, sms, mms, earliest, latest, and a total row with year null."""
    return messages.withColumn("year", F.year(F.timestamp_millis("date"))).rollup("year").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "sms").alias("sms"), F.count_if(F.col("kind") == "mms").alias("mms"), F.min("date").alias("earliest"), F.max("date").alias("latest"))


def years_covered(*years: DataFrame) -> DataFrame:
    """years: the sorted distinct years of all inputs, joined by commas; one row."""
    every = years[0].select("year")
    for y in years[1:]:
        every = every.union(y.select("year"))
    return every.where("year is not null").distinct().agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))


def top_k(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def share(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def coverage(rows: DataFrame, covered: Column, *by: str) -> DataFrame:
    """by, total, covered, percent, with a total row."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(covered).alias("covered")).withColumn("percent", share(F.col("covered"), F.col("total")))


def penalty_score(rows: DataFrame, severity: str, weights: dict[str, float], *by: str) -> DataFrame:
    """by, score: 100 less the weights of the rows' severities, between 0 and 100."""
    w = F.lit(0.0)
    for name, weight in weights.items():
        w = F.when(F.col(severity) == name, F.lit(float(weight))).otherwise(w)
    return rows.groupBy(*by).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.sum(w))), 2).alias("score"))


def grade(score: str = "score") -> Column:
    """A to F by tens."""
    c = F.col(score)
    return F.when(c >= 90, "A").when(c >= 80, "B").when(c >= 70, "C").when(c >= 60, "D").otherwise("F")


def worst(rows: DataFrame, status: str, ranks: dict[str, int], *by: str) -> DataFrame:
    """by, status: the worst status of each group."""
    rank = F.coalesce(*[F.when(F.col(status) == name, F.lit(r)) for name, r in ranks.items()], F.lit(-1))
    return rows.groupBy(*by).agg(F.max_by(status, rank).alias("status"))
