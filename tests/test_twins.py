"""Every registered query against its SQL twin, on the smallest data set."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

FOLDER = os.environ.get("TWIN_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_same_as_sql(spark, con, name):
    found = differences(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert [d for d in found if d != "no rows at all"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "customer_id"
