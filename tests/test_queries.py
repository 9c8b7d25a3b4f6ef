"""Every query with SQL gives the rows that DuckDB finds."""

import math
import os

import duckdb
import pandas as pd
import pytest

from matchgrid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "year"):
        t = pd.Timestamp(x)
        return str(t.date()) if t == t.normalize() else str(t)
    if isinstance(x, (str, bool)):
        return x
    return bool(x) if "bool" in type(x).__name__ else round(float(x), 5) + 0.0


def rows(pdf, columns):
    return sorted((tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(ORACLE_SQL[name]).df()
    assert sorted(expected.columns) == columns
    got = rows(df.toPandas(), columns)
    assert got and got == rows(expected, columns)
