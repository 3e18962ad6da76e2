"""The queries on the smallest test data, and their SQL."""

import os

import duckdb
import pytest

from recordloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    got = sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())
    if name in queries.oracle_sql():
        c = duckdb.connect()
        c.execute("SET TimeZone='UTC'")
        for f in os.listdir(sf):
            c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
        r = c.execute(queries.oracle_sql()[name])
        columns = [d[0] for d in r.description]
        assert got == sorted(tuple(str(x[columns.index(k)]) for k in sorted(columns)) for x in r.fetchall())
