"""Pages over any order, found by order statistics, against sorting everything."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowferry.operators import paging

SCHEMA = "t string, n long, d double, x decimal(12,2), at timestamp, nt timestamp_ntz, day date, ok boolean, raw binary, tags array<string>"


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)

    def maybe(value):
        return None if rng.random() < 0.2 else value

    rows = []
    for _ in range(500):
        when = dt.datetime(2024, 10, 27, rng.randrange(4), rng.randrange(60), 0, rng.randrange(1_000_000))
        rows.append((
            maybe(rng.choice(["", "a", "A", "é", "z漢", "zz", "\U0001f600"])), maybe(rng.randrange(5)), maybe(rng.choice([0.1, -0.0, 1e300, float("nan"), float("inf"), 1 / 3])),
            maybe(Decimal(rng.randrange(-500, 500)) / 100), maybe(when), maybe(when), maybe(when.date()), maybe(rng.random() < 0.5), maybe(bytes([rng.randrange(256)])), maybe(["q", None][: rng.randrange(3)]),
        ))
    return spark.createDataFrame(rows + rows[:40] * 5, SCHEMA).repartition(4)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(paging, "FRONT", 12)
    monkeypatch.setattr(paging, "_COPIES", 7)


def content(rows):
    return [repr(tuple(r)) for r in rows]


@pytest.mark.parametrize("order", [["t", "d"], ["tags", "at"]])
def test_pages_of_any_order_equal_the_sorted_table(mixed, small, order):
    whole = content(paging.TotalOrder(mixed, order).sort(mixed).collect())
    for offset, limit in ((333, 0), (len(whole) - 5, 50)):
        got = content(paging.page(mixed, order, offset, limit).collect())
        assert got == (whole[offset : offset + limit] if limit else whole[offset:]), (offset, limit)


def test_order_is_that_of_the_engine(mixed):
    rows = mixed.select("t", "n", "d").distinct()
    assert content(paging.page(rows, ["n", "t", "d"], 0, 30).collect()) == content(rows.orderBy("n", "t", "d").limit(30).collect())


def test_equal_rows_are_counted_and_made_by_many_tasks(spark, small):
    rows = spark.range(300).select(F.when(F.col("id") < 250, 5).otherwise(F.col("id")).alias("v"))
    got = paging.deep_page(rows, ["v"], 13, 200)
    assert [r.v for r in got.collect()] == [5] * 200
    assert [r.v for r in paging.deep_page(rows, ["v"], 240, 12).collect()] == [5] * 10 + [250, 251]
    assert [r.v for r in paging.page(rows, ["v"], 249).collect()] == [5, *range(250, 300)]


def test_all_that_follow_stay_in_many_partitions(spark):
    rows = spark.range(0, 400_000, 1, 8).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rest = paging.page(rows, ["name"], 100_000)
        assert rest.rdd.getNumPartitions() > 1
        assert "SinglePartition" not in rest._jdf.queryExecution().executedPlan().toString()
        assert rest.count() == 300_000 and rest.first() == rows.orderBy("name").offset(100_000).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("offset", [3, 499])
def test_deep_pages_equal_plain_pages(spark, offset):
    df = spark.range(1000).selectExpr("IF(id % 11 = 0, NULL, IF(id % 3 = 0, 7, id % 50)) AS a", "id")
    want = df.orderBy("a", "id").offset(offset).limit(40).collect()
    assert paging.deep_page(df, ["a", "id"], offset, 40, cuts=20).collect() == want


def test_page_rules(spark):
    assert [paging.clamp_page(p) for p in (-1, 0, 1, 12)] == [1, 1, 1, 12]
    assert [paging.clamp_page_size(s) for s in (-9, 0, 7, 200, 201)] == [50, 50, 7, 200, 201]
    with pytest.raises(ValueError, match="largest"):
        paging.clamp_page_size(201, 200)
    assert paging.page(spark.range(5), ["id"], 2, 0).count() == 3
    assert paging.page(spark.range(0), ["id"], 2, 0).collect() == []
    with pytest.raises(ValueError, match="no column"):
        paging.page(spark.range(5), ["nope"], 2, 0)


def test_preview_pages_never_overlap_without_an_order(spark):
    rows = spark.range(0, 90, 1, 6).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    seen = [tuple(r) for n in (1, 2, 3) for r in paging.preview(rows, n, 30).rows.collect()]
    assert sorted(seen) == sorted(tuple(r) for r in rows.collect())
    own = paging.preview(rows.orderBy(F.desc("b")), 2, 4)
    assert [r.b for r in own.rows.collect()] == [85, 84, 83, 82] and own.total == 90
