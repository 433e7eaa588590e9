"""Every registered query against DuckDB; an empty result is no proof and fails."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from forecastlab.catalog import load

SF_DIR = os.environ.get("FORECASTLAB_SF_DIR", "/root/testdata/sf0.001")


LARGER = "/root/testdata/sf0.01"  # for queries whose result is empty on the smallest tables


def views(folder):
    con = duckdb.connect()
    for table in check.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(SF_DIR)


NAMES = list(load().ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    result = check.compare(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name])
    if result.startswith("EMPTY"):
        result = check.compare(entry.queries()[name](spark, LARGER), views(LARGER), entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
