"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert compare(entry.queries()[name](spark, SMALL), duck, SQL[name]) is None


def test_names_agree():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["cycle", "kind", "name", "value"] and rows.count() > 20
