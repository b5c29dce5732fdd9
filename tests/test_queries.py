"""Every registered query against its SQL on DuckDB, or at least run, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf_dir, duck):
    df = QUERIES[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if key not in SQL:
        assert df.columns and rows
        return
    cur = duck.execute(SQL[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(names, cur.fetchall())


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
