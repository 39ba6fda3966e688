"""Every registered query with a SQL counterpart gives the same rows and values as DuckDB."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check import compare, duck

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    status, detail, other = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert status == "ok", (detail, other)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
