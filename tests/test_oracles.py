"""Every query with SQL gives what DuckDB gives on the smallest test data."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, float) else v
    return sorted(([fix(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert mine == _rows(names, rel.fetchall())


def test_every_other_query_runs(spark, sf):
    for name, q in entry.queries().items():
        if name not in SQL:
            assert q(spark, sf).count() >= 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
