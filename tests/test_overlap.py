"""Rows that arrive below the mark, over several runs."""

import datetime as dt

import pytest

from rowferry.model import Endpoint, JobSpec, Watermark
from rowferry.plans import jobs


def run(spark, out, rows, schema, **more):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/src/t")
    base = dict(name="j", source=Endpoint("parquet", path=f"{out}/src"), source_table="t", target=Endpoint("parquet", path=f"{out}/dst"), target_table="t", quality=False)
    spec = JobSpec(**{**base, **more})
    result = jobs.run_job(spark, spec, f"{out}/root")
    assert result.status == "success", result.error
    return result.rows, sorted((tuple(r) for r in jobs.read_target(spark, spec.target, "t", spec.keys).collect()), key=repr)


def test_late_rows_ties_and_repeats_come_once(spark, out):
    schema, mark = "id long, v string", Watermark("id", "id", overlap=10)
    rows = [(i, f"v{i}") for i in range(0, 40, 2)] + [(38, "tie"), (None, "null")]
    assert run(spark, out, rows, schema, watermark=mark) == (22, sorted(rows, key=repr))
    late = [(31, "late"), (38, "another tie"), (38, "tie"), (40, "new"), (None, "null too")]
    n, got = run(spark, out, late, schema, watermark=mark)
    assert n == 4 and got == sorted(rows + late[:4], key=repr)  # a null mark belongs to the first run
    n, got = run(spark, out, [(5, "below the overlap"), (33, "late again")], schema, watermark=mark)
    assert n == 1 and got == sorted(rows + late[:4] + [(33, "late again")], key=repr)
    assert run(spark, out, [], schema, watermark=mark)[0] == 0
    assert run(spark, out, [(39, "once more")], schema, watermark=mark)[0] == 1


def test_times_and_keyed_targets(spark, out):
    schema = "at timestamp_ntz, k int, v string"
    at = lambda s, us=0: dt.datetime(2024, 3, 31, 1, 59, s, us)
    job = dict(watermark=Watermark("at", "timestamp", overlap=20), write="upsert", keys=["k"], order_by=["at"], buckets=2)
    run(spark, out, [(at(1), 1, "a"), (at(30), 2, "b"), (at(30, 1), 3, "c")], schema, **job)
    n, got = run(spark, out, [(at(30, 1), 4, "tie"), (at(15), 5, "late"), (at(2), 6, "too late")], schema, **job)
    assert n == 2 and [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(1, "a"), (2, "b"), (3, "c"), (4, "tie"), (5, "late")]


def test_chunks_and_overlap_exclude_each_other(spark, out):
    spark.range(3).write.parquet(f"{out}/src/t")
    spec = JobSpec("j", Endpoint("parquet", path=f"{out}/src"), Endpoint("parquet", path=f"{out}/dst"), source_table="t", chunks=2, watermark=Watermark("id", "id", overlap=1))
    assert "overlap" in jobs.run_job(spark, spec, f"{out}/root").error


@pytest.mark.parametrize("mark, value, want", [(Watermark("x", "id", 5), "12", "7"), (Watermark("x", "id"), "12", "12"), (Watermark("x", "id", 5), "", "")])
def test_lower_marks(mark, value, want):
    assert jobs.lower_mark(mark, value) == want
