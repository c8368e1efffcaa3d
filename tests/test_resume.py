"""Copies in chunks that break off anywhere and go on, and balanced ranges."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowferry.model import Endpoint, JobSpec, Watermark
from rowferry.operators import shards
from rowferry.plans import jobs, queries
from rowferry.plans.store import KeyedTable, copy_ledger
from rowferry.sources import jdbc


def source(spark, out, rows):
    rows.write.mode("append").parquet(f"{out}/src/t")


def spec(out, **more):
    base = dict(name="j", source=Endpoint("parquet", path=f"{out}/src"), source_table="t", target=Endpoint("parquet", path=f"{out}/dst"), target_table="t", chunks=3, quality=False)
    return JobSpec(**{**base, **more})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def breaks(monkeypatch):
    """Makes a function of the jobs module fail on its nth call, before or after it did its work."""

    def use(name, nth, after=False):
        was, calls = getattr(jobs, name), []

        def broken(*args, **kwargs):
            calls.append(1)
            if len(calls) == nth and not after:
                raise RuntimeError("broken")
            out = was(*args, **kwargs)
            if len(calls) == nth:
                raise RuntimeError("broken")
            return out

        monkeypatch.setattr(jobs, name, broken)

    return use


@pytest.mark.parametrize("name, nth, after", [("_write_chunk", 2, True), ("move_in", 3, False), ("set_mark", 1, False)])
def test_plain_files_hold_every_row_once(spark, out, breaks, name, nth, after):
    rows = spark.range(200).selectExpr("IF(id % 9 = 0, NULL, id) AS id", "concat('r', id) AS v", "id AS n")
    source(spark, out, rows)
    job = spec(out, chunk_key="id", watermark=Watermark("n", "id"))
    breaks(name, nth, after)
    assert jobs.run_job(spark, job, f"{out}/root").status == "failed"
    assert jobs.last_mark(spark, f"{out}/root", "j") in ("", "199") and (name == "set_mark" or jobs.last_mark(spark, f"{out}/root", "j") == "")
    source(spark, out, spark.range(500, 510).selectExpr("id", "'late' AS v", "id AS n"))  # not part of the copy that goes on
    again = jobs.run_job(spark, job, f"{out}/root")
    assert (again.status, again.rows, again.high_water) == ("success", 200, "199")
    assert rows_of(jobs.read_target(spark, job.target, "t")) == rows_of(rows)
    third = jobs.run_job(spark, job, f"{out}/root")
    assert (third.rows, third.high_water) == (10, "509")
    assert jobs.read_target(spark, job.target, "t").count() == 210


@pytest.mark.parametrize("write", ["append", "upsert"])
def test_keyed_tables_recognise_a_chunk(spark, out, breaks, write):
    rows = spark.range(120).selectExpr("id % 100 AS id", "id AS v") if write == "upsert" else spark.range(120).selectExpr("id", "id AS v")
    source(spark, out, rows)
    job = spec(out, write=write, keys=["id"], order_by=["v"], buckets=3)
    breaks("_write_chunk", 2, after=True)
    assert jobs.run_job(spark, job, f"{out}/root").status == "failed"
    commits = KeyedTable(spark, f"{out}/dst/t", ["id"]).last_commit()
    assert jobs.run_job(spark, job, f"{out}/root").status == "success"
    table = KeyedTable(spark, f"{out}/dst/t", ["id"])
    assert rows_of(table.read()) == sorted([(i, i + 100 if write == "upsert" and i < 20 else i) for i in range(100 if write == "upsert" else 120)], key=repr)
    assert table.last_commit() == commits + 1
    states = Counter(r["state"] for r in copy_ledger(spark, f"{out}/root").all().collect())
    assert states == {"planned": 1, "written": 3, "whole": 1}


def test_what_a_chunked_copy_asks_for(spark, out):
    source(spark, out, spark.range(5))
    assert "chunk_key" in jobs.run_job(spark, spec(out), f"{out}/root").error
    assert "upsert" in jobs.run_job(spark, spec(out, chunk_key="id", target=Endpoint("mysql")), f"{out}/root").error
    empty = spec(out, name="none", filter="id > 10", chunk_key="id", target=Endpoint("csv", path=f"{out}/csv"), target_table="")
    result = jobs.run_job(spark, empty, f"{out}/root")
    assert (result.status, result.rows) == ("success", 0)


def test_ranges_hold_like_numbers_of_rows(spark):
    rng = random.Random(1)
    keys = [int(1.02 ** rng.randrange(2000)) for _ in range(4000)]
    df = spark.createDataFrame([(k, f"é{k}", None if i % 10 == 0 else float(k)) for i, k in enumerate(keys)], "n long, t string, d double").withColumn("at", F.timestamp_seconds(F.col("n") % 10**9))
    for key in ("n", "t", "d", "at"):
        cuts = shards.balanced_cuts(df, key, 5)
        parts = [df.where(p).count() for p in cuts.predicates(key)]
        assert sum(parts) == 4000 and len(parts) == 5
        known = df.where(F.col(key).isNotNull()).groupBy(cuts.shard_of(key)).count().collect()
        assert all(abs(r[1] - sum(x[1] for x in known) / 5) < 0.02 * 4000 for r in known)
        # A row's number is that of the only predicate it meets.
        numbered = df.select(cuts.shard_of(key).alias("s"), *[F.expr(p).alias(f"p{i}") for i, p in enumerate(cuts.predicates(key))])
        assert numbered.where(" OR ".join(f"p{i} <> (s = {i})" for i in range(5))).isEmpty()


@pytest.mark.parametrize("top", [9_000_000, 3_000_000_000])
def test_balanced_shards_of_many_orders(spark, out, top):
    step = top // 8000
    spark.range(8001).select((F.col("id") * step).alias("l_orderkey"), F.lit(1).alias("l_linenumber")).write.parquet(f"{out}/lineitem.parquet")
    got = queries.balanced_shards(spark, out)
    assert rows_of(got) == [("at", 8, True, 8001), ("name", 8, True, 8001), ("squared", 8, True, 8001)]


def test_ranges_of_one_key_and_of_nothing(spark):
    same = spark.range(50).selectExpr("'x' AS t")
    assert shards.balanced_cuts(same, "t", 4).predicates("t") == ["true"]
    assert rows_of(shards.union_of_ranges(same, "t", 4)) == rows_of(same)
    assert shards.union_of_ranges(same.limit(0), "t", 4).count() == 0
    assert shards.balanced_cuts(spark.createDataFrame([(None,)], "t string"), "t", 4).edges == ()


def test_a_database_cuts_its_own_ranges():
    e = Endpoint("postgresql", database="d")
    text = jdbc.edges_query(e, "t", "name", 4, "x > 1")
    assert 'NTILE(4) OVER (ORDER BY "name")' in text and text.endswith("GROUP BY TILE") and "(x > 1)" in text
    import datetime as dt

    from pyspark.sql import types as T

    assert [jdbc.edge_literal(v, k) for v, k in (("it's", T.StringType()), (5, T.LongType()), (dt.date(2024, 1, 2), T.DateType()))] == ["'it''s'", "5", "DATE '2024-01-02'"]
    assert shards.edge_predicates('"k"', ("1", "5")) == ['("k" < 1 OR "k" IS NULL)', '"k" >= 1 AND "k" < 5', '"k" >= 5']


def test_an_error_of_the_check_is_in_the_log(spark, out, monkeypatch):
    source(spark, out, spark.range(5))
    monkeypatch.setattr(jobs, "check_quality", lambda *a, **k: 1 / 0)
    result = jobs.run_job(spark, spec(out, chunks=0, quality=True), f"{out}/root")
    assert result.status == "success"
    row = jobs.run_log(spark, f"{out}/root").latest().first()
    assert (row["status"], row["quality_status"]) == ("success", "error") and "division by zero" in row["error_msg"]
