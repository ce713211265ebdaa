"""Every probe query against its SQL on the smallest tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, duck, key):
    assert differences(QUERIES[key](spark, FOLDER), duck, ORACLES[key]) == []


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0
