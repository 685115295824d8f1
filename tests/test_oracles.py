"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
