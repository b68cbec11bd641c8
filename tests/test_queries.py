"""Every registered query against its checking SQL on the smallest tables."""

import pytest
from compare import SF, compare, connect

import __spark_entry__ as entry
from oracle.catalog import all_sql
from pageprism.plans.catalog import all_queries

QUERIES, SQL = all_queries(), all_sql()
#: Estimates; test_sketches.py holds them against their stated error.
ESTIMATES = {"tracker_adoption_days"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | ESTIMATES and not set(SQL) & ESTIMATES


def test_entry(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize("name", SQL)
def test_query(spark, con, name):
    state, _, _ = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert state == "ok"
