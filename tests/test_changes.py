"""Change feeds against a row-by-row replay."""

import random

import pytest

from pyspark.sql import functions as F

from rowferry.model import FieldMapping
from rowferry.operators import changes as X

ROW = "STRUCT<k: INT, v: INT, w: STRING>"
FEED = f"seq BIGINT, op STRING, before {ROW}, after {ROW}, unchanged ARRAY<STRING>"


def replay(table, events, mode="strict"):
    """``table``: key to (v, w, note); events: (seq, op, before, after, unchanged)."""
    t = dict(table)
    for _, op, before, after, unchanged in sorted(events, key=lambda e: e[0]):
        if op == "D":
            t.pop((before or after)[0], None)
            continue
        k, v, w = after
        moved = op == "U" and before is not None and before[0] != k
        if moved:
            old = t.pop(before[0], None)
            t.pop(k, None)
            kept = before[1] if "v" in (unchanged or ()) else v
            t[k] = (kept, w, None)
            del old
            continue
        here = k in t
        if mode == "strict" and here != (op == "U"):
            continue
        old = t.get(k, (None, None, None))
        t[k] = (old[0] if "v" in (unchanged or ()) else v, w, old[2])
    return t


def random_events(rng, n, keys, moves=False, partial=False):
    out = []
    for seq in range(n):
        op = rng.choice("IUUD")
        k = rng.randrange(keys)
        unchanged = ["v"] if partial and op == "U" and rng.random() < 0.4 else None
        after = (k, None if unchanged else rng.randint(0, 99), f"w{seq}")
        before = None
        if op == "D":
            before, after = (k, None, None), None
        elif op == "U" and moves and rng.random() < 0.3:
            before = (rng.randrange(keys), rng.randint(0, 99), "old")
        out.append((seq, op, before, after, unchanged))
    return out


def run(spark, table, events, partial=True, **options):
    t = spark.createDataFrame([(k, *v) for k, v in table.items()], "k int, v int, w string, note string")
    feed = spark.createDataFrame(events, FEED)
    if not partial:
        feed = feed.drop("unchanged")
    return X.apply_changes(t, feed, ["k"], **options)


def as_dict(df):
    got = [tuple(r) for r in df.collect()]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g[1:] for g in got}


START = {k: (k, f"s{k}", f"note{k}") for k in range(0, 80, 2)}


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("mode", ["strict", "upsert"])
@pytest.mark.parametrize("moves, partial", [(False, False), (True, False), (False, True)])
def test_set_based_equals_replay(spark, seed, mode, moves, partial):
    events = random_events(random.Random(seed), 900, 80, moves, partial)
    assert as_dict(run(spark, START, events, partial, mode=mode)) == replay(START, events, mode)


def test_batch_edges_do_not_matter(spark):
    events = random_events(random.Random(5), 600, 60, moves=True)
    table = START
    for low, high in ((0, 10), (10, 11), (11, 400), (400, 600)):
        table = as_dict(run(spark, table, events[low:high], False))
    assert table == replay(START, events)


def test_a_hot_key_is_folded_in_stretches(spark):
    """One key with a third of all events, in levels of any size; orders may be sparse or below zero."""
    events = random_events(random.Random(9), 900, 80, partial=True)
    events = [
        (s, op, (7, None, None) if op == "D" else None, None if op == "D" else (7, *a[1:]), u) if s % 3 == 0 else (s, op, b, a, u)
        for s, op, b, a, u in events
    ]
    want = replay(START, events)
    for bits, spread in ((4, 1), (3, 1_000_003), (16, -1_000_003)):
        placed = [(s * abs(spread) + (-(10**9) if spread < 0 else 0), *e) for s, *e in events]
        assert as_dict(run(spark, START, placed, level_bits=bits)) == want


def test_a_level_moves_rows_once_and_joins_nothing(spark):
    events = random_events(random.Random(2), 200, 20)
    feed = spark.createDataFrame(events, FEED).drop("unchanged")
    plan = X.fold_events(feed, ["k"], level_bits=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_half_of_very_many_events_on_one_key(spark):
    """No group of events is larger than a stretch, so no task holds the key."""
    n = 400_000
    op = F.when(F.col("id") % 1000 == 999, "D").when(F.col("id") % 1000 == 5, "I").otherwise("U")
    key = F.when(F.col("id") % 2 == 1, 0).otherwise(F.col("id") % 5000)
    feed = spark.range(n).select(F.col("id").alias("seq"), op.alias("op"), F.struct(key.cast("int").alias("k"), F.col("id").cast("int").alias("v"), F.lit("w").alias("w")).alias("after"))
    table = spark.createDataFrame([(0, -1, "s", "n")], "k int, v int, w string, note string")
    got = as_dict(X.apply_changes(table, feed, ["k"], level_bits=10))
    assert 0 not in got  # its last event is a delete
    again = as_dict(X.apply_changes(table, feed.where(F.col("seq") < n - 1), ["k"], level_bits=10))
    assert again[0] == (n - 3, "w", None)  # revived by 5 after the delete at 999, then updated to the last odd number


@pytest.mark.parametrize("mode", ["strict", "upsert"])
def test_a_small_outcome_may_be_broadcast(spark, mode):
    events = random_events(random.Random(3), 400, 80)
    t = spark.createDataFrame([(k, *v) for k, v in START.items()], "k int, v int, w string, note string")
    feed = spark.createDataFrame(events, FEED).drop("unchanged")
    folded = X.fold_events(feed, ["k"], mode)
    got = X.settle(t, folded, ["k"], feed.schema["after"].dataType, mode, small=True)
    assert as_dict(got) == replay(START, events, mode)


def test_first_insert_after_the_last_delete_counts(spark):
    events = [(1, "D", (0, None, None), None, None), (2, "U", None, (0, 1, "lost"), None), (3, "I", None, (0, 2, "kept"), None), (4, "I", None, (0, 3, "refused"), None)]
    assert as_dict(run(spark, {0: (9, "x", "n")}, events, False)) == {0: (2, "kept", None)}


def test_new_feed_columns_are_added_and_text_becomes_the_targets_type(spark):
    t = spark.createDataFrame([(1, False, 5)], "k int, ok boolean, n int")
    feed = spark.createDataFrame(
        [(1, "U", (1, "t", "77", "new")), (2, "I", (2, "false", "x", None))], "seq long, op string, after STRUCT<k: INT, ok: STRING, n: STRING, extra: STRING>"
    )
    got = sorted(tuple(r) for r in X.apply_changes(t, feed, ["k"]).collect())
    assert got == [(1, True, 77, "new"), (2, False, None, None)]


def test_mapped_feed(spark):
    t = spark.createDataFrame([(1, 5, "n")], "id int, value int, w string")
    feed = spark.createDataFrame([(1, "U", None, (1, 6, "z"), ["v"]), (2, "I", None, (2, 7, "y"), None)], FEED)
    maps = [FieldMapping("k", "id"), FieldMapping("v", "value"), FieldMapping("w", "", True)]
    got = sorted(tuple(r) for r in X.apply_changes(t, feed, ["id"], mappings=maps).collect())
    assert got == [(1, 5, "z"), (2, 7, "y")]
    dropped = X.map_feed(feed, [FieldMapping("w", enabled=False)])
    assert dropped.schema["after"].dataType.names == ["k", "v"]


def test_bad_events_are_set_aside(spark):
    events = [(None, "I", None, (1, 1, "a"), None), (1, "X", None, (1, 1, "a"), None), (2, "U", None, None, None), (3, "I", None, (None, 1, "a"), None), (4, "D", (1, 1, "a"), None, None)]
    good, bad = X.split_feed(spark.createDataFrame(events, FEED), ["k"])
    assert [r["seq"] for r in good.collect()] == [4]
    assert sorted(r["reason"] for r in bad.collect()) == ["no row image", "no sequence number", "null key", "unknown operation"]


def test_keyless_feed(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 2, None)], "k int, v int, w string")
    events = [
        (1, "I", None, (3, 3, "c"), None),
        (2, "D", (1, 1, "a"), None, None),
        (3, "D", (3, None, None), None, None),
        (4, "I", None, (3, 3, "c"), None),
        (5, "U", None, (2, 9, "z"), None),
        (6, "D", (2, None, "q"), None, None),
    ]
    got = sorted((tuple(r) for r in X.apply_keyless(t, spark.createDataFrame(events, FEED)).collect()), key=repr)
    assert got == [(2, 2, None), (3, 3, "c")]


def test_images_are_read_once(spark, out):
    """One scan folds the feed; the pass before it that finds its span reads keys and order only."""
    spark.range(10).selectExpr("id AS seq", "'U' AS op", "named_struct('k', id, 'wide', 'x') AS after").write.parquet(out)
    feed = spark.read.parquet(out)
    t = spark.createDataFrame([], "k long, wide string")
    plan = X.apply_changes(t, feed, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    events = X._events(feed, ["k"]).where("k0 IS NOT NULL").agg(F.max("ord"))
    assert "ReadSchema: struct<seq:bigint,op:string,after:struct<k:bigint>>" in events._jdf.queryExecution().executedPlan().toString() or "ReadSchema: struct<seq:bigint,after:struct<k:bigint>>" in events._jdf.queryExecution().executedPlan().toString()


