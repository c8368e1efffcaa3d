"""Every registered query against plain SQL in another engine."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from rowferry.plans import oracles
from rowferry.plans import queries as registered

# Queries of further subpackages are compared by those subpackages' own tests.
SQL = oracles.oracle_sql()
QUERIES = registered.queries()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    con = connect(sf)
    assert compare(spark, con, QUERIES[name], SQL[name], sf) == ""
