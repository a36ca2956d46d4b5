"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import database, difference
from runledger.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return database(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert {query.__name__ for query in catalog.QUERIES} <= set(ORACLES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert rows.columns[:2] == ["job_id", "phase"]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, tables, name):
    assert difference(QUERIES[name](spark, SF), tables, ORACLES[name]) is None
