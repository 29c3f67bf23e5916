"""Every query with a SQL twin agrees with DuckDB on the small tables."""

import os

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con.sql(oracle_sql()[name])) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    assert entry(spark).columns == ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
