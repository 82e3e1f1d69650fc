"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(con, entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["folder", "n"] and df.count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
