"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import SPARK_TYPES, rows_of
from citeloom.catalog.registry import TABLE_NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLE_NAMES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, key):
    df = entry.queries()[key](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.columns) == sorted(cols)
    assert {n: SPARK_TYPES.get(k, k) for n, k in df.dtypes} == types
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, result.fetchall())


@pytest.mark.parametrize("key", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, key):
    assert entry.queries()[key](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
