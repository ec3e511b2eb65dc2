"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
import suite
from tools.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(suite.ORACLES) == set(suite.QUERIES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["bucket", "service", "count"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, connection, name):
    assert compare(spark, connection, SF, entry.queries()[name], entry.oracle_sql()[name]) is None
