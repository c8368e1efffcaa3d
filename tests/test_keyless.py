"""Tables without a key on a stream, against the batch form over the whole feed."""

import random

import pytest
from pyspark.sql import functions as F

from rowferry.operators import keyless
from rowferry.operators.changes import apply_keyless
from rowferry.streaming import replicate as R

ROW = "STRUCT<a: INT, b: STRING>"


def random_feed(rng, n):
    out = []
    for seq in range(n):
        op = rng.choice("IIIUD")
        row = (rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]))
        if op == "D" and rng.random() < 0.5:
            row = (row[0], None)
        out.append((seq, "t", op, row if op == "D" else None, None if op == "D" else row))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def start(spark):
    return spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, None), (None, "y"), (9, "z")], "a int, b string")


def test_stream_equals_the_whole_feed(spark, start, out):
    schema = f"seq long, table string, op string, before {ROW}, after {ROW}"
    feed = spark.createDataFrame(random_feed(random.Random(3), 120), schema)
    bag = R.load_keyless(start, f"{out}/t", buckets=3)
    commits = []
    for low, high in ((0, 40), (40, 41), (41, 120)):
        feed.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{out}/feed")
        source = R.read_feed(spark, f"{out}/feed", feed.schema, "t", fmt="parquet")
        R.replicate_keyless(source, bag, f"{out}/c", f"{out}/dead").awaitTermination()
        commits.append(bag.last_commit())
    assert commits == [1, 2, 3]
    assert rows_of(keyless.from_bag(bag.read())) == rows_of(apply_keyless(start, feed))
    # Each distinct row is there once.
    assert bag.read().groupBy("a", "b").count().where("count > 1").isEmpty()


def test_a_batch_that_runs_again_is_left_alone(spark, start, out):
    feed = spark.createDataFrame([(1, "t", "I", None, (5, "n"))], f"seq long, table string, op string, before {ROW}, after {ROW}")
    feed.write.parquet(f"{out}/feed")
    bag = R.load_keyless(start, f"{out}/t", buckets=2)
    R.replicate_keyless(R.read_feed(spark, f"{out}/feed", feed.schema, "t", fmt="parquet"), bag, f"{out}/c", f"{out}/dead").awaitTermination()
    from rowferry.session import remove

    remove(spark, f"{out}/c/query/commits")  # the driver dies after the table's commit
    R.replicate_keyless(R.read_feed(spark, f"{out}/feed", feed.schema, "t", fmt="parquet"), bag, f"{out}/c", f"{out}/dead").awaitTermination()
    assert rows_of(keyless.from_bag(bag.read())) == rows_of(start.union(spark.createDataFrame([(5, "n")], start.schema)))


def test_bags_give_back_their_rows(spark, start, monkeypatch):
    monkeypatch.setattr(keyless, "_BLOCK", 3)
    many = start.union(spark.range(100).selectExpr("7 as a", "'same' as b"))
    bag = keyless.as_bag(many, many.columns)
    assert bag.count() == 6 and rows_of(keyless.from_bag(bag)) == rows_of(many)


def test_unfit_values_and_new_columns(spark, start, out):
    wide = "STRUCT<a: STRING, b: STRING, extra: STRING>"
    feed = spark.createDataFrame([(1, "t", "I", None, ("12", "n", "e")), (2, "t", "I", None, ("no number", "n", None)), (3, "t", "D", ("1", None, None), None)], f"seq long, table string, op string, before {wide}, after {wide}")
    feed.write.parquet(f"{out}/feed")
    bag = R.load_keyless(start, f"{out}/t", buckets=2)
    R.replicate_keyless(R.read_feed(spark, f"{out}/feed", feed.schema, "t", fmt="parquet"), bag, f"{out}/c", f"{out}/dead").awaitTermination()
    got = keyless.from_bag(bag.read())
    assert rows_of(got) == sorted([(12, "n", "e"), (2, None, None), (None, None, None), (None, "y", None), (9, "z", None)], key=repr)
    assert spark.read.json(f"{out}/dead").first()["reason"] == "value of another type"
