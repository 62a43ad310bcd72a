"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from framelake.plans import catalog
from framelake.sources.adapters import TABLES

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    return con


#: Queries that no SQL states; each function of fn_special has a query with SQL of its own.
BY_HAND = {"fn_special"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    if name not in SQL:
        assert got and name in BY_HAND
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5)) for x, y in zip(a, b, strict=True)), (a, b)
