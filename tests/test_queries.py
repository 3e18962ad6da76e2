"""Every core query against its SQL in DuckDB, as the driver checks them."""

import os

import duckdb
import pytest

from recordloom.plans import catalog


def _text(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "\0" if v is None else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") and hasattr(v, "tzinfo") else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got, columns = df.collect(), df.columns
    assert len(set(columns)) == len(columns)
    if name not in catalog.oracle_sql():
        return
    r = duck.execute(catalog.oracle_sql()[name])
    names, expected = [d[0] for d in r.description], r.fetchall()
    order = sorted(columns)
    assert order == sorted(names)
    assert sorted(tuple(_text(x[c]) for c in order) for x in got) == sorted(tuple(_text(x[names.index(c)]) for c in order) for x in expected)
