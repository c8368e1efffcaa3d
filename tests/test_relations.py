"""Feeds of bare values against reading them message by message."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from rowferry.operators import relations as R
from rowferry.plans.store import KeyedTable
from rowferry.streaming import replicate as S


def told(seq, names, relation=1, table="public.t"):
    kinds = {"k": "int4", "v": "int4", "n": "numeric(10,2)"}
    return (seq, "R", relation, table, [(c, kinds.get(c, "text")) for c in names], None, None)


def cells(*values):
    return [("n", None) if v is None else ("u", None) if v == "*" else ("t", str(v)) for v in values]


def event(seq, kind, values, relation=1, old=None):
    side = cells(*values)
    return (seq, kind, relation, None, None, side if kind == "D" else (cells(*old) if old else None), None if kind == "D" else side)


def replay(start, messages, mode="strict"):
    """The table and the rejects, one message at a time; rows are dicts."""
    rows, layouts, bad = {k: dict(v) for k, v in start.items()}, {}, []
    for seq, kind, relation, table, columns, before, after in sorted(messages, key=lambda m: m[0]):
        if kind == "R":
            layouts[relation] = (table, [c for c, _ in columns])
            continue
        if relation not in layouts:
            bad.append((seq, "unknown relation"))
            continue
        name, names = layouts[relation]
        values = before if kind == "D" else after
        if max(len(before or []), len(after or [])) > len(names):
            bad.append((seq, "more values than columns"))
            continue
        if name != "public.t":
            continue
        got = {c: v for c, (t, v) in zip(names, values) if t != "u"}
        if got.get("k") is None:
            bad.append((seq, "null key"))
            continue
        key = int(got["k"])
        if kind == "D":
            rows.pop(key, None)
        elif kind == "I" and key not in rows:
            rows[key] = got
        elif kind == "U" and key in rows:
            rows[key].update(got)
    return {k: {c: v for c, v in r.items() if v is not None} for k, r in rows.items()}, sorted(bad)


def as_rows(df):
    rows = {}
    for r in df.collect():
        assert r["k"] not in rows
        rows[r["k"]] = {c: str(v) for c, v in r.asDict().items() if v is not None}
    return rows


def texts(rows):
    return {k: {c: str(v) for c, v in r.items()} | {"k": str(k)} for k, r in rows.items()}


def random_messages(rng, n):
    names, out = ["k", "v"], [told(0, ["k", "v"])]
    for seq in range(1, n):
        if rng.random() < 0.02:
            names = rng.sample(["k", "v", "a", "b", "c"], rng.randrange(1, 6))
            names = names if "k" in names else ["k", *names]
            out.append(told(seq, names))
            continue
        kind = rng.choice("IUUD")
        row = {c: rng.choice([None, rng.randrange(100)]) if c == "v" else rng.choice([None, f"{c}{seq}"]) for c in names} | {"k": rng.randrange(25)}
        values = [row[c] if c == "k" or kind != "U" or rng.random() < 0.7 else "*" for c in names]
        cut = len(values) if names.index("k") else rng.randrange(1, len(values) + 1)
        out.append(event(seq, kind, values[:cut] + ([1, 2, 3, 4, 5] if rng.random() < 0.02 else []), relation=rng.choice([1] * 30 + [9])))
    return out


START = {k: {"v": k, "home": f"h{k}"} for k in range(0, 25, 2)}


def target(spark):
    return spark.createDataFrame([(k, r["v"], r["home"]) for k, r in START.items()], "k int, v int, home string")


@pytest.mark.parametrize("seed", [1])
def test_every_event_is_read_by_its_version(spark, seed):
    messages = random_messages(random.Random(seed), 500)
    want, bad = replay(START, messages)
    got, rejects = R.apply_messages(target(spark), spark.createDataFrame(messages, R.MESSAGES), "public.t", ["k"])
    assert as_rows(got) == texts(want)
    assert sorted((r["seq"], r["reason"]) for r in rejects.collect()) == bad


def test_types_repeats_and_other_messages(spark):
    messages = [
        (0, "B", None, None, None, None, None), told(1, ["k", "n"]), told(1, ["k", "n"]), told(2, ["k", "x"], 2, "public.other"), event(3, "I", [1, "2.50"]),
        event(4, "I", [5, "q"], 2), event(5, "U", [1, "many"]), (6, "C", None, None, None, None, None), (7, "T", 1, None, None, None, None), event(8, "D", [7, None]), (None, "I", 1, None, None, None, cells(1, 2)),
    ]
    table = spark.createDataFrame([(7, "gone")], "k int, home string")
    got, rejects = R.apply_messages(table, spark.createDataFrame(messages, R.MESSAGES), "public.t", ["k"])
    assert got.schema["n"].dataType == T.DecimalType(10, 2)
    assert [tuple(map(str, r)) for r in got.collect()] == [("1", "None", "2.50")]
    assert sorted((r["seq"] or -1, r["reason"]) for r in rejects.collect()) == [(-1, "unknown relation"), (5, "value of another type"), (7, "unknown operation")]


def test_no_description_at_all(spark):
    got, rejects = R.apply_messages(target(spark), spark.createDataFrame([event(1, "I", [1, 2])], R.MESSAGES), "public.t", ["k"])
    assert as_rows(got) == texts(START) and rejects.count() == 1
    empty, none = R.apply_messages(target(spark), spark.createDataFrame([], R.MESSAGES), "public.t", ["k"])
    assert as_rows(empty) == texts(START) and none.count() == 0


def test_descriptions_last_over_batches_and_restarts(spark, out):
    messages = random_messages(random.Random(7), 240)
    table = KeyedTable(spark, f"{out}/t", ["k"], 3)
    table.commit(target(spark))
    for low, high in ((0, 90), (90, 91), (91, 240)):
        spark.createDataFrame([m for m in messages if low <= m[0] < high], R.MESSAGES).coalesce(1).write.mode("append").parquet(f"{out}/feed")
        S.replicate_messages(spark.readStream.schema(R.MESSAGES).parquet(f"{out}/feed"), table, "public.t", f"{out}/c", f"{out}/dead").awaitTermination()
    want, bad = replay(START, messages)
    assert as_rows(table.read()) == texts(want)
    if bad:
        assert spark.read.json(f"{out}/dead").count() == len(bad)


def test_events_are_not_moved_to_be_read(spark):
    messages = spark.createDataFrame([told(0, ["k"]), event(1, "I", [1])], R.MESSAGES)
    with R.Staged(R.versions(R.relation_messages(messages)), "relations") as known:
        feed, _ = R.decode(messages, known, "public.t", R.table_fields(known.df, "public.t"))
        plan = feed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert feed.where(F.col("op") == "I").count() == 1


def test_a_batch_is_read_once_and_by_many_tasks(spark, out, monkeypatch):
    plans = []

    def merge(target, good, *rest, was=S._merge_feed):
        plans.append(good._jdf.queryExecution().executedPlan().toString())
        return was(target, good, *rest)

    monkeypatch.setattr(S, "_merge_feed", merge)
    monkeypatch.setattr(S, "relation_messages", lambda messages, was=S.relation_messages: was(messages).withColumn("task", F.spark_partition_id()))
    table = KeyedTable(spark, f"{out}/t", ["k"], 3)
    table.commit(target(spark))
    for messages in (
        [told(0, ["k", "v"]), event(1, "U", [2, 5]), event(2, "I", [1, 7])],
        [told(3, ["v", "k"]), event(4, "U", ["x", 4]), event(5, "U", [1, 6], relation=9), event(6, "U", [8, 6])],
    ):
        spark.createDataFrame(messages, R.MESSAGES).coalesce(1).write.mode("append").parquet(f"{out}/feed")
    S.replicate_messages(spark.readStream.schema(R.MESSAGES).parquet(f"{out}/feed"), table, "public.t", f"{out}/c", f"{out}/dead").awaitTermination()
    # Descriptions come from the tasks that read them, and what is folded and merged is an outcome that was written.
    assert spark.read.parquet(f"{out}/c/relations").select("task").distinct().count() == 2
    assert len(plans) == 1 and "Join" not in plans[0] and "InMemoryTableScan" not in plans[0]
    rows = as_rows(table.read())
    assert rows[1] == {"k": "1", "v": "7"} and [rows[k]["v"] for k in (2, 4, 6)] == ["5", "4", "8"]
    dead = spark.read.json(f"{out}/dead").select(F.from_json("event", "seq long, kind string, relation long").alias("e"), "reason")
    assert sorted(tuple(r["e"]) + (r["reason"],) for r in dead.collect()) == [(4, "U", None, "value of another type"), (5, "U", 9, "unknown relation")]
