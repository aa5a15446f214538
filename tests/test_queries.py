"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not on this machine")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        assert got_columns
        return
    rel = duck.sql(sql)
    want_columns, want = rows_of(rel.columns, rel.fetchall())
    assert got_columns == want_columns
    assert got == want


def test_entry_runs(spark):
    assert spark_entry.entry(spark).count() > 0
