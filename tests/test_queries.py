"""Every registered query against its SQL twin on the small tables."""

import pytest
from conftest import SF
from oracle import compare, duck

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, msg, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, msg


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
