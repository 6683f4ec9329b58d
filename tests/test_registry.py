"""Registered queries against their check SQL on the smallest data set."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.check_sql import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    ok, message = compare(spark, con, key, QUERIES[key], ORACLE.get(key), SF)
    assert ok, message
    assert "TYPES" not in message, message


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
