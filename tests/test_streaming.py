import json
from collections import Counter
import random

import pytest
from pyspark.sql import types as T

from rowferry.model import Endpoint, FieldMapping, JobSpec
from rowferry.plans.store import KeyedTable
from rowferry.streaming import replicate as R
from test_changes import START, as_dict, random_events, replay

ROW = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.IntegerType()), T.StructField("w", T.StringType())])


def as_json(events, table="t"):
    def image(row):
        return None if row is None else dict(zip(("k", "v", "w"), row))

    return [json.dumps({"seq": s, "table": table, "op": op, "before": image(b), "after": image(a)}) for s, op, b, a, _ in events]


def deliver(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def start(spark, out, table, **options):
    feed = R.read_feed(spark, f"{out}/feed", R.feed_schema(ROW), "t", max_files=1)
    return R.replicate(feed, table, f"{out}/cp", f"{out}/rejects", **options)


def test_stream_equals_replay_across_restarts(spark, out):
    table = KeyedTable(spark, f"{out}/t", ["k"], buckets=4)
    table.commit(spark.createDataFrame([(k, *v) for k, v in START.items()], "k int, v int, w string, note string"))
    events = random_events(random.Random(11), 300, 80, moves=True)
    for low, high in ((0, 120), (120, 300)):
        deliver(spark, f"{out}/feed", [*as_json(events[low:high]), "{broken", *as_json(events[:3], "other")])
        start(spark, out, table).awaitTermination()
    assert as_dict(table.read()) == replay(START, events)
    rejects = spark.read.json(f"{out}/rejects")
    assert [r["reason"] for r in rejects.collect()] == ["unreadable", "unreadable"]


def test_a_repeated_batch_changes_nothing(spark, out):
    table = KeyedTable(spark, f"{out}/t", ["k"], buckets=4)
    table.commit(spark.createDataFrame([(1, 1, "a")], "k int, v int, w string"))
    deliver(spark, f"{out}/feed", as_json([(1, "I", None, (2, 2, "b"), None)]))
    start(spark, out, table).awaitTermination()
    before, commits = as_dict(table.read()), table.last_commit()
    # The commit is there, but the query's own record of the batch is lost.
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/cp/query/commits/0")
    fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(fs, True)
    start(spark, out, table).awaitTermination()
    assert as_dict(table.read()) == before and table.last_commit() == commits


def test_other_writers_do_not_hide_a_batch(spark, out):
    table = KeyedTable(spark, f"{out}/t", ["k"], buckets=2)
    table.commit(spark.createDataFrame([(1, 1, "a")], "k int, v int, w string"))
    for seq in (2, 3):
        deliver(spark, f"{out}/feed", as_json([(seq, "I", None, (seq, seq, "f"), None)]))
        start(spark, out, table).awaitTermination()
        table.merge([spark.range(1).selectExpr("1 AS k")], lambda old: old)
        table.merge([spark.range(1).selectExpr("2 AS k")], lambda old: old)
    assert sorted(as_dict(table.read())) == [1, 2, 3]


def test_a_feed_needs_a_first_load(spark, out):
    deliver(spark, f"{out}/feed", as_json([(1, "I", None, (2, 2, "b"), None)]))
    with pytest.raises(ValueError):
        start(spark, out, KeyedTable(spark, f"{out}/t", ["k"]))


def test_one_query_per_name(spark, out):
    table = KeyedTable(spark, f"{out}/t", ["k"], buckets=2)
    table.commit(spark.createDataFrame([(1, 1, "a")], "k int, v int, w string"))
    deliver(spark, f"{out}/feed", as_json([(1, "I", None, (2, 2, "b"), None)]))
    first = start(spark, out, table, name="job-1", trigger={"processingTime": "1 hour"})
    assert R.is_running(spark, "job-1")
    second = start(spark, out, table, name="job-1", trigger={"processingTime": "1 hour"})
    assert not first.isActive and second.isActive
    R.stop_all(spark)
    assert not R.is_running(spark, "job-1")


def test_only_touched_buckets_are_written(spark, out):
    table = KeyedTable(spark, f"{out}/t", ["k"], buckets=16)
    table.commit(spark.range(400).selectExpr("CAST(id AS int) AS k", "1 AS v", "'a' AS w"))
    deliver(spark, f"{out}/feed", as_json([(1, "U", None, (5, 9, "z"), None)]))
    start(spark, out, table).awaitTermination()
    pairs = table._current()
    assert sorted(Counter(f for _, f in pairs).values()) == [1, 15]
    assert table.read().where("v = 9").count() == 1 and table.read().count() == 400
    assert table.expire() == []


@pytest.mark.parametrize("initial", [True, False])
def test_a_realtime_job_loads_then_follows(spark, out, initial):
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k int, v int, w string").write.parquet(f"{out}/src/t")
    deliver(spark, f"{out}/feed", as_json([(1, "U", None, (1, 5, "z"), None), (2, "I", None, (3, 3, "c"), None), (3, "D", (2, 2, "b"), None, None)]))
    spec = JobSpec(
        name="follow",
        source=Endpoint("parquet", path=f"{out}/src"),
        source_table="t",
        target=Endpoint("parquet", path=f"{out}/dst"),
        target_table="t",
        keys=["k"],
        mappings=[FieldMapping("k", "id"), FieldMapping("v"), FieldMapping("w", "word")],
        quality=False,
    )
    feed = R.read_feed(spark, f"{out}/feed", R.feed_schema(ROW), "t")
    R.start_realtime(spark, spec, feed, out, initial_load=initial).awaitTermination()
    table = KeyedTable(spark, f"{out}/dst/t", ["id"])
    assert table.read().columns == ["id", "v", "word"]
    assert as_dict(table.read()) == ({1: (5, "z"), 3: (3, "c")} if initial else {3: (3, "c")})
