"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as driver
from suite.compare import connect, differences
from suite.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    _, found = differences(spark, con, SF_DIR, name)
    assert found == []


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry_counts(spark):
    assert driver.entry(spark).count() == 383
