"""Every query with SQL against DuckDB over the smallest tables; the others run and have rows."""

import glob
import os

import duckdb
import pytest

from voltrail.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0
