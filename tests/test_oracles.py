"""Every registered query of the library against its SQL in DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from graphloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.collect() is not None
