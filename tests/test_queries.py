"""Every registered query against its check SQL on the smallest data set."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ordermill.catalog import ORACLES, QUERIES
from tests.oracle import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(queries()[name](spark, DATA), duck, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 145
