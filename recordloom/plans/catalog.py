"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.operators import instants, lineparse, packed
from recordloom.plans import analysis, checks, lines_sql, more, records, roundtrips, store, streams, tracking, whole
from recordloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per value of every field that holds two or more values."""
    return packed.packed_values(table(spark, sf, "imports"), table(spark, sf, "unprocessed"), table(spark, sf, "contacts"), least=2)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """One UTC instant for each timestamp of ``imports`` that isn't epoch milliseconds."""
    return instants.utc_instants(table(spark, sf, "imports"), table(spark, sf, "devices"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The refused call lines with each reason."""
    return lineparse.refused_lines(table(spark, sf, "call_lines"))


def p5_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The other call lines as typed calls."""
    return lineparse.valid_calls(table(spark, sf, "call_lines"))


_PLANS = (records, store, analysis, more, streams, whole, checks, roundtrips, tracking)


def queries() -> dict[str, Query]:
    """Query by name."""
    out = {f.__name__: f for f in (p2_found, p3_found, p5_found, p5_valid)}
    for plan in _PLANS:
        out |= plan.query.queries
    return out


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    out = {"p5_valid": lines_sql.valid_lines()}
    for plan in _PLANS:
        out |= plan.query.sql
    return out
