"""Every query with a check SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from scripts.check_oracle import compare
from tidemark.sources.bindings import TABLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare(name, QUERIES[name](spark, SF_DIR), con, SQL[name]) in (None, "EMPTY RESULT")


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
