"""The registered queries of the training-data operators against SQL in another engine."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from rowferry.llm import oracles, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, connect(sf), queries.queries()[name], SQL[name], sf) == ""


def test_all_are_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in found


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_mixing", "op5_licenses", "op13_filter_audit"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct")), plan
