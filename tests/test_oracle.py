"""Every query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    msg, _, _, ok = compare(spark, con, name, SF, entry.oracle_sql().get(name))
    assert ok, msg
