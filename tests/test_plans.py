"""What the physical plans must look like."""

import pytest

from rowferry.operators import merge as M
from rowferry.plans import queries as registered

QUERIES = registered.queries()
# Whole jobs and streams: what they return is a plain read of what they wrote.
WRITTEN = (
    "filtered_copy", "incremental_two_runs", "incremental_ltz_whole", "resumed_copy", "resumed_job", "resumed_upsert", "late_rows", "upsert_job", "csv_round_trip", "export_query", "sql_import",
    "stream_replicate", "stream_keyless", "stream_schema_messages", "chained_upsert", "document_round_trip", "verified_job", "run_log_rows",
)
PURE = [n for n in QUERIES if n not in WRITTEN]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_query_multiplies_rows_or_runs_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["table_scan"](spark, sf))
    assert "GreaterThan(l_quantity,45.0)" in text and "EqualTo(l_returnflag,R)" in text
    assert "l_extendedprice" not in text
    text = plan(QUERIES["incremental_ts"](spark, sf))
    assert "GreaterThan(ts,2024-01-20T04:00)" in text and "props" not in text
    text = plan(QUERIES["or_filter_with_watermark"](spark, sf))
    assert "GreaterThan(o_orderkey,700)" in text and "Or(" in text
    assert "GreaterThanOrEqual(doc_id" in plan(QUERIES["shard_union"](spark, sf))


def test_count_reads_the_filter_column_only(spark, sf):
    assert "ReadSchema: struct<l_discount:double>" in plan(QUERIES["filtered_count"](spark, sf))


def test_digests_travel_not_rows(spark, sf):
    text = plan(QUERIES["differing_keys"](spark, sf))
    exchange = text[text.index("Exchange") :]
    assert "Join" not in text and "HashAggregate" in exchange


def test_pages_are_a_top_n(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["page_offset"](spark, sf))
    assert "TakeOrderedAndProject" in plan(QUERIES["latest_runs"](spark, sf))


def test_a_small_merge_leaves_the_target_unshuffled(spark, sf):
    target = spark.read.parquet(f"{sf}/orders.parquet")
    fresh = target.limit(5).select("o_orderkey", "o_totalprice")
    merged = M.upsert_settled(target, fresh, ["o_orderkey"], small=True)
    kept = merged._jdf.queryExecution().optimizedPlan().toString()
    text = plan(merged)
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 2 and "Union" in kept


def test_a_merge_shuffles_each_side_once(spark, sf):
    text = plan(QUERIES["upsert"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in text
