import random

import pytest

from rowferry.operators import merge as M
from rowferry.operators import mapping, quality, shards, filters
from rowferry.model import FieldMapping, Watermark


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_mapping_rules(spark):
    df = spark.createDataFrame([(7, 2.5, "A", "Z")], "part int, price double, shelf string, maker string")
    maps = [FieldMapping("price", "retail"), FieldMapping("shelf", "place", False), FieldMapping("maker", ""), FieldMapping("part", "part")]
    assert mapping.map_columns(df, maps).columns == ["retail", "maker", "part"]
    assert mapping.map_columns(df, []).columns == df.columns


def test_upsert_equals_row_by_row_writes(spark):
    rng = random.Random(7)
    target = [(k, rng.randint(0, 9), f"keep{k}") for k in range(0, 60, 2)]
    source = [(rng.randint(0, 70), i, rng.randint(10, 99)) for i in range(300)]
    want = {k: (v, note) for k, v, note in target}
    for k, _, v in source:
        want[k] = (v, want[k][1] if k in want else None)
    t = spark.createDataFrame(target, "k int, v int, note string")
    s = spark.createDataFrame(source, "k int, at int, v int")
    settled = M.keep_last(s, ["k"], ["at"]).select("k", "v")
    for small, nulls in ((False, True), (True, True), (False, False), (True, False)):
        assert rows(M.upsert_settled(t, settled, ["k"], small, nulls)) == sorted(((k, *v) for k, v in want.items()), key=repr)
    again = M.upsert(M.upsert(t, settled, ["k"], ["v"]), settled, ["k"], ["v"])
    assert rows(again) == rows(M.upsert(t, settled, ["k"], ["v"]))


def test_skip_keeps_the_first_new_row(spark):
    t = spark.createDataFrame([(1, "old")], "k int, v string")
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 2)], "k int, v string, at int")
    assert rows(M.insert_skip(t, s, ["k"], ["at"]).select("k", "v")) == [(2, "b")]


def test_replace_drops_fields_the_input_lacks(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, gone int")
    s = spark.createDataFrame([(1, "new", True)], "k int, v string, extra boolean")
    got = {r["k"]: r.asDict() for r in M.replace_rows(t, s, ["k"], []).collect()}
    assert got[1] == {"k": 1, "v": "new", "gone": None, "extra": True}
    assert got[2]["gone"] == 6


def test_insert_refuses_duplicates(spark):
    t = spark.createDataFrame([(1,)], "k int")
    for bad in ([(1,)], [(2,), (2,)]):
        with pytest.raises(M.DuplicateKey):
            M.insert_checked(t, spark.createDataFrame(bad, "k int"), ["k"])
    assert M.insert_checked(t, spark.createDataFrame([(2,)], "k int"), ["k"]).count() == 1


def test_key_only_tables_gain_rows(spark):
    t, s = spark.createDataFrame([(1, 1)], "a int, b int"), spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert rows(M.upsert(t, s, ["a", "b"], [])) == [(1, 1), (1, 2)]


def test_null_keys_are_one_key(spark):
    t = spark.createDataFrame([(None, "old")], "k int, v string")
    s = spark.createDataFrame([(None, "new")], "k int, v string")
    for small in (False, True):
        assert rows(M.upsert_settled(t, s, ["k"], small)) == [(None, "new")]


@pytest.mark.parametrize("keys, source", [([], "k int"), (["x"], "k int"), (["k"], "k int, other int")])
def test_upsert_checks_its_arguments(spark, keys, source):
    t = spark.createDataFrame([], "k int, v int")
    with pytest.raises(ValueError):
        M.upsert(t, spark.createDataFrame([], source), keys, [])


def test_a_hot_key_leaves_one_row_per_task(spark):
    """A third of the rows on one key: the cut happens before the shuffle."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS at")
    last = M.keep_last(df, ["k"], ["at"])
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Exchange")
    assert last.where("k = 0").first()["at"] == 29_997


def test_shards_cover_everything_once(spark, sf):
    df = spark.read.parquet(f"{sf}/labels.parquet")
    for n in (1, 3, 8):
        plan = shards.key_range(df, "doc_id", n)
        parts = [df.where(p) for p in plan.predicates("doc_id")]
        assert sum(p.count() for p in parts) == df.count()
    assert shards.check_shards(0) == 1 and len(shards.KeyRange(0, 999, shards.check_shards(64, 64)).predicates("k")) == 64
    with pytest.raises(ValueError, match="max_shards"):
        shards.check_shards(64)


def test_shards_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k int")
    assert shards.shard_counts(empty, "k", 4).count() == 0
    edge = spark.createDataFrame([(None,), (-5,), (0,), (7,)], "k int")
    parts = [edge.where(p).count() for p in shards.key_range(edge, "k", 3).predicates("k")]
    assert sum(parts) == 4
    text = spark.createDataFrame([(f"k{i}",) for i in range(100)], "k string")
    assert shards.shard_counts(text, "k", 4).selectExpr("sum(rows)").first()[0] == 100


def test_watermarks(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 10:00:00'), (2, timestamp_ntz'2024-01-01 10:00:01'), (3, NULL) AS t(id, at)")
    at, key = Watermark("at", "timestamp"), Watermark("id", "id")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(filters.after_mark(df, at, "2024-01-01T10:00:00Z")) == [2]
    assert ids(filters.after_mark(df, at, "2024-01-01T12:00:00+02:00")) == [2]
    assert ids(filters.after_mark(df, at)) == [1, 2, 3]
    assert ids(filters.after_mark(df, at, "", "2024-01-01T10:00:00Z")) == [1, 3]
    assert ids(filters.after_mark(df, key, "1", "2")) == [2]
    zoned = df.selectExpr("id", "CAST(at AS timestamp) AS at")
    assert ids(filters.after_mark(zoned, at, "2024-01-01T10:00:00Z")) == [2]
    with pytest.raises(ValueError):
        Watermark("x", "version")


def test_filters_keep_their_own_or(spark):
    df = spark.range(10)
    assert filters.where_all(df, "id = 1 OR id = 8", "id > 5", "", None).collect()[0]["id"] == 8
    assert filters.lookup(df, "id", [3, 4, 99]).count() == 2


DOC = "STRUCT<a: STRUCT<b: INT>, tags: ARRAY<STRING>, n: BIGINT, name: STRING>"


@pytest.mark.parametrize(
    "text, want",
    [
        ("", [1, 2, 3]),
        ('{"a.b": 2}', [1]),
        ('{"a.b": {"$ne": 2}}', [2, 3]),
        ('{"tags": "x"}', [1, 2]),
        ('{"n": {"$gte": 5, "$lt": 9}}', [1]),
        ('{"n": {"$numberLong": "9"}}', [2]),
        ('{"name": null}', [3]),
        ('{"name": {"$exists": true}, "$or": [{"n": 5}, {"n": 9}]}', [1, 2]),
        ('{"$and": [{"n": {"$nin": [5]}}, {"name": {"$in": ["q"]}}]}', [2]),
        ('{"missing": {"$exists": false}}', [1, 2, 3]),
    ],
)
def test_document_filters(spark, text, want):
    df = spark.sql(
        "SELECT * FROM VALUES (1, named_struct('b', 2), array('x'), 5L, 'p'), (2, named_struct('b', 3), array('x', 'y'), 9L, 'q'),"
        " (3, NULL, array(), NULL, NULL) AS t(id, a, tags, n, name)"
    )
    assert [r["id"] for r in df.where(filters.document_predicate(df.schema, text)).orderBy("id").collect()] == want


@pytest.mark.parametrize("text", ["{bad", "[1]", '{"a": {"$regex": "x"}}', '{"$nor": []}'])
def test_bad_document_filters(spark, text):
    with pytest.raises(ValueError):
        filters.document_predicate(spark.range(1).schema, text)


# --- quality ---


def pair(spark, n, missing=0, drift=0, by=1.0):
    s = spark.range(n).selectExpr("id", "id * 1.5D AS v", "concat('12abc', id) AS t")
    t = s.where(f"id >= {missing}").selectExpr("id AS key", f"v + if(id >= {n - drift}, {by}D, 0D) AS v", "t")
    return s, t, [("id", "key"), ("v", "v"), ("t", "t")]


@pytest.mark.parametrize(
    "n, missing, drift, by, status",
    [
        (1000, 0, 0, 1.0, "passed"),
        (1000, 5, 0, 1.0, "warning"),
        (1000, 20, 0, 1.0, "failed"),
        (50, 0, 50, 0.00005, "passed"),
        (50, 0, 2, 1.0, "failed"),
        (50, 0, 1, 1.0, "passed"),
        (0, 0, 0, 1.0, "passed"),
    ],
)
def test_quality_status(spark, n, missing, drift, by, status):
    s, t, pairs = pair(spark, n, missing, drift, by)
    row = quality.check_quality(s, t, pairs, ["id"]).first()
    assert row["status"] == status and row["sample_total"] == min(n, 50)


def test_sample_is_the_same_every_time(spark):
    df = spark.range(1000)
    first = {r["id"] for r in quality.pick_keys(df, ["id"]).collect()}
    assert first == {r["id"] for r in quality.pick_keys(df.repartition(7), ["id"]).collect()} and len(first) == 50
    assert {r["id"] for r in quality.pick_keys(df, ["id"], how="first").collect()} == set(range(50))


def test_texts_that_start_alike_do_not_match(spark):
    s = spark.createDataFrame([(1, "12abc"), (2, "2024-01-01"), (3, "1.0"), (4, None)], "id int, t string")
    t = spark.createDataFrame([(1, "12xyz"), (2, "2024-09-09"), (3, "1.00004"), (4, None)], "id int, t string")
    row = quality.full_compare(s, t, ["id"], [("t", "t")]).first()
    assert (row["matched"], row["diff_t"]) == (2, 2)


def test_full_compare_counts_and_repeats(spark):
    s = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, 3)], "id int, v int")
    t = spark.createDataFrame([(1, 1), (1, 1), (2, 9), (4, 4)], "id int, v int")
    row = quality.full_compare(s, t, ["id"], [("v", "v")]).first().asDict()
    assert row == {"source_keys": 3, "matched": 1, "missing": 1, "extra": 1, "diff_v": 1, "source_repeats": 1, "target_repeats": 1}
    assert rows(quality.differing_keys(s, t, ["id"], [("v", "v")])) == [(1, 2, 2), (2, 1, 1), (3, 1, 0), (4, 0, 1)]


def test_both_full_comparisons_agree(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0), (4, 4.0), (5, 5.0), (5, 5.0)], "id int, v double")
    t = spark.createDataFrame([(1, 1.00001), (2, 9.0), (None, 3.0), (5, 5.0), (6, 6.0)], "id int, v double")
    whole = quality.full_compare(s, t, ["id"], [("v", "v")]).first().asDict()
    assert whole == {"source_keys": 5, "matched": 2, "missing": 2, "extra": 2, "diff_v": 1, "source_repeats": 1, "target_repeats": 0}
    assert quality.compare_tables(s, t, ["id"], [("v", "v")]).first().asDict() == whole


def test_nulls_leave_a_trace_in_digests(spark):
    s = spark.createDataFrame([(1, None, "x"), (2, "y", None), (3, None, None)], "id int, a string, b string")
    t = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, None, None)], "id int, a string, b string")
    pairs = [("a", "a"), ("b", "b")]
    assert [r["id"] for r in quality.differing_keys(s, t, ["id"], pairs).orderBy("id").collect()] == [1, 2]
    whole = quality.full_compare(s, t, ["id"], pairs).first().asDict()
    assert whole["matched"] == 1 and quality.compare_tables(s, t, ["id"], pairs).first().asDict() == whole
    maps = spark.sql("SELECT 1 AS id, map('a', 1) AS m")
    assert quality.differing_keys(maps, maps, ["id"], [("m", "m")]).count() == 0


def test_exact_types_are_compared_exactly(spark):
    from rowferry.functions.compare import values_match

    df = spark.sql("SELECT 12345678901234567890.01BD AS a, 12345678901234567990.01BD AS b, 12345678901234567890.01BD AS c, 9007199254740993L AS d, 9007199254740992L AS e, 1.00001BD AS f, 1L AS g")
    def same(x, y):
        return df.select(values_match(df[x], df[y], df.schema[x].dataType, df.schema[y].dataType).alias("m")).first()["m"]

    assert not same("a", "b") and same("a", "c") and not same("d", "e") and same("f", "g") and not same("a", "g")


def test_composite_key_samples_hold_exact_keys(spark):
    s = spark.range(100).selectExpr("id div 10 AS a", "id % 10 AS b", "id AS v")
    row = quality.sample_compare(s, s.where("v <> 0"), ["a", "b"], [("v", "v")], 10, "first").first()
    assert (row["sample_total"], row["sample_matched"]) == (10, 9)


def test_a_hot_key_does_not_multiply_in_a_comparison(spark):
    s = spark.range(60_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id % 3 AS v")
    row = quality.full_compare(s, s, ["k"], [("v", "v")]).first()
    assert row["source_keys"] == row["matched"] == 40_001
