"""Every registered query runs; those with SQL match DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry_
from oracle import connect, differences

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(entry_.queries()))
def test_query(spark, duck, name):
    df = entry_.queries()[name](spark, DIRECTORY)
    sql = entry_.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    got, want, only_got, only_want = differences(df, duck, sql)
    assert (got, only_got, only_want) == (want, [], [])
    assert got > 0


def test_entry(spark):
    assert entry_.entry(spark).columns == ["area", "position", "path", "priority", "drivers"]
