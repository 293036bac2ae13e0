"""Every registered query runs, and agrees with its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    _, _, difference = compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert difference is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
