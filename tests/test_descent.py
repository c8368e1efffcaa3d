"""Comparison by digests of key ranges against comparing every key."""

import pytest
from pyspark.sql import functions as F

from rowferry.operators import quality as Q

PAIRS = [("a", "a"), ("b", "b2")]


def pair(spark, change):
    source = spark.range(4000).selectExpr("id AS k", "concat('k', lpad(id, 5, '0')) AS t", "id % 7 AS a", "IF(id % 5 = 0, NULL, concat('b', id)) AS b")
    return source, change(source).withColumnRenamed("b", "b2")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CHANGES = {
    "one value": lambda s: s.withColumn("a", F.when(F.col("k") == 1234, -1).otherwise(F.col("a"))),
    "a null for a value": lambda s: s.withColumn("b", F.when(F.col("k") == 17, None).otherwise(F.col("b"))),
    "swapped rows": lambda s: s.withColumn("a", F.when(F.col("k") == 7, 6).when(F.col("k") == 6, 0).otherwise(F.col("a"))),
    "missing and extra": lambda s: s.where("k <> 3999 AND k <> 0").union(s.where("k = 5").selectExpr("k + 90000", "'z'", "a", "b")),
    "everything": lambda s: s.withColumn("a", F.col("a") + 1),
    "nothing": lambda s: s,
}


@pytest.mark.parametrize("name", list(CHANGES))
def test_descent_finds_what_a_comparison_of_all_keys_finds(spark, name):
    source, target = pair(spark, CHANGES[name])
    key = "t" if name in ("one value", "missing and extra") else "k"
    assert rows_of(Q.descend(source, target, [key], PAIRS, ranges=8, least=100)) == rows_of(Q.differing_keys(source, target, [key], PAIRS))


def test_only_ranges_that_differ_are_read_again(spark, out):
    source, target = pair(spark, CHANGES["one value"])
    region, levels = Q.differing_region(source, target, ["k"], PAIRS, ranges=8, least=100)
    left = source.select(F.col("k").alias("k0")).where(region)
    assert levels == 3 and left.count() <= 100 and left.where("k0 = 1234").count() == 1
    source.write.parquet(out)
    plan = spark.read.parquet(out).select(F.col("k").alias("k0")).where(region)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan
    same = Q.differing_region(source, source.withColumnRenamed("b", "b2"), ["k"], PAIRS, ranges=8, least=100)
    assert same == ("false", 1)


def test_null_keys_and_empty_tables(spark):
    source, target = pair(spark, CHANGES["nothing"])
    extra = source.limit(1).selectExpr("cast(NULL AS long) AS k", "t", "a", "b")
    got = Q.descend(source.union(extra), target.union(extra), ["k"], PAIRS, ranges=8, least=100)
    assert rows_of(got) == [(None, 1, 1)]
    assert Q.descend(source.limit(0), target.limit(0), ["k"], PAIRS).count() == 0
    assert Q.descend(source.limit(0), target, ["k"], PAIRS).count() == 4000
