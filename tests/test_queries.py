"""Every query with SQL, held against DuckDB over sf0.001."""

import math

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    key = lambda row: tuple((v is not None, v) for v in row)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    other = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[k]) for k in other) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
