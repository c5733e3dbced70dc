"""Every registered query with an SQL counterpart gives DuckDB's rows."""

import compare
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    assert compare.differences(entry.queries()[name](spark, sf_dir), duck, SQL[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
