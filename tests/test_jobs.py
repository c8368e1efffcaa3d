import os
import time

import pytest

from rowferry.model import Endpoint, FieldMapping, JobSpec, ParamDef, Watermark
from rowferry.operators import merge as M
from rowferry.plans import jobs
from rowferry.plans.preview import eligible, export_job, preview_job
from rowferry.plans.store import KeyedTable, range_bucket, run_log
from rowferry.session import matching, remove
from rowferry.sources.files import read_csv


def latest_run(spark, root):
    return run_log(spark, root).latest().orderBy("start_time", ascending=False).first()


def spec(out, **more):
    base = dict(
        name="job",
        source=Endpoint("parquet", path=f"{out}/src"),
        source_table="t",
        target=Endpoint("parquet", path=f"{out}/dst"),
        target_table="t",
    )
    return JobSpec(**{**base, **more})


def save(spark, out, sql, mode="overwrite"):
    spark.sql(sql).write.mode(mode).parquet(f"{out}/src/t")


def test_copy_logs_rows_and_quality(spark, out):
    save(spark, out, "SELECT id AS k, id * 2 AS v FROM range(200)")
    job = spec(out, keys=["k"], filter="k >= 100 OR k = 1", mappings=[FieldMapping("k", "key"), FieldMapping("v")])
    result = jobs.run_job(spark, job, out)
    assert (result.status, result.rows) == ("success", 101)
    assert result.quality == {"source_rows": 101, "target_rows": 101, "sample_total": 50, "sample_matched": 50, "quality_status": "passed"}
    row = latest_run(spark, out)
    assert (row["status"], row["rows_synced"], row["quality_status"]) == ("success", 101, "passed")
    assert jobs.read_target(spark, job.target, "t", ["key"]).columns == ["key", "v"]


def test_append_refuses_a_repeated_run(spark, out):
    save(spark, out, "SELECT id AS k FROM range(5)")
    assert jobs.run_job(spark, spec(out, keys=["k"]), out).status == "success"
    again = jobs.run_job(spark, spec(out, keys=["k"]), out)
    assert again.status == "failed" and "duplicate key" in again.error
    assert latest_run(spark, out)["status"] == "failed"
    assert jobs.run_job(spark, spec(out, keys=["k"], write="skip"), out).status == "success"
    assert jobs.read_target(spark, Endpoint("parquet", path=f"{out}/dst"), "t", ["k"]).count() == 5


@pytest.mark.parametrize("more", [dict(kind="mirror"), dict(write="merge"), dict(write="upsert"), dict(kind="sql_import"), dict(source=Endpoint("ftp"))])
def test_bad_jobs_fail_in_the_log(spark, out, more):
    save(spark, out, "SELECT 1 AS k")
    result = jobs.run_job(spark, spec(out, **more), out)
    assert result.status == "failed" and result.error and latest_run(spark, out)["error_msg"] == result.error


def test_two_incremental_runs_equal_one_copy(spark, out):
    save(spark, out, "SELECT id, IF(id = 3, NULL, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id div 2)) AS at FROM range(10)")
    job = spec(out, watermark=Watermark("at", "timestamp"), quality=False)
    assert jobs.run_job(spark, job, out).rows == 10
    assert jobs.run_job(spark, job, out).rows == 0
    save(spark, out, "SELECT id, timestamp_ntz'2024-02-01 00:00:00.000001' + make_interval(0,0,0,0,0,0, id) AS at FROM range(10, 14)", "append")
    assert jobs.run_job(spark, job, out).rows == 4
    assert jobs.last_mark(spark, out, "job") == "2024-02-01T00:00:13.000001Z"
    got = jobs.read_target(spark, job.target, "t")
    assert sorted(r["id"] for r in got.collect()) == list(range(14))
    jobs.set_mark(spark, out, "job", "")
    assert jobs.run_job(spark, job, out).rows == 14


def test_a_failed_run_keeps_the_mark(spark, out):
    save(spark, out, "SELECT id FROM range(10)")
    good = spec(out, watermark=Watermark("id", "id"), quality=False)
    assert jobs.run_job(spark, good, out).high_water == "9"
    save(spark, out, "SELECT id FROM range(10, 20)", "append")
    bad = spec(out, watermark=Watermark("id", "id"), mappings=[FieldMapping("nope")])
    assert jobs.run_job(spark, bad, out).status == "failed"
    assert jobs.last_mark(spark, out, "job") == "9"


def test_upsert_and_replace_jobs(spark, out):
    save(spark, out, "SELECT id AS k, 'a' AS v, 1 AS n FROM range(50)")
    target = Endpoint("mongodb", path=f"{out}/docs")
    assert jobs.run_job(spark, spec(out, target=target, keys=["k"], quality=False), out).status == "success"
    save(spark, out, "SELECT k, 'b' AS v, at FROM (SELECT 3 AS k, 1 AS at UNION ALL SELECT 60, 2)")
    job = spec(out, target=target, keys=["k"], order_by=["at"], write="replace", quality=False)
    assert jobs.run_job(spark, job, out).status == "success"
    got = {r["k"]: r for r in jobs.read_target(spark, target, "t", ["k"]).collect()}
    assert len(got) == 51 and got[3]["n"] is None and got[60]["at"] == 2 and got[4]["n"] == 1


def test_structure_then_data(spark, out):
    save(spark, out, "SELECT id AS k, 'x' AS name, 1 AS hidden FROM range(5)")
    job = spec(out, kind="both", keys=["k"], mappings=[FieldMapping("k"), FieldMapping("name", "called"), FieldMapping("hidden", enabled=False)], quality=False)
    result = jobs.run_job(spark, job, out)
    assert result.status == "success", result.error
    assert jobs.read_target(spark, job.target, "t", ["k"]).columns == ["k", "called"]
    assert KeyedTable(spark, f"{out}/dst/t", ["k"]).last_commit() == 1


def test_verify_updates_the_newest_run(spark, out):
    save(spark, out, "SELECT id AS k FROM range(100)")
    job = spec(out, keys=["k"], filter="k < 50", quality=False)
    jobs.run_job(spark, job, out)
    assert jobs.verify_job(spark, job, out)["quality_status"] == "failed"
    row = latest_run(spark, out)
    assert (row["source_rows"], row["target_rows"], row["quality_status"], row["status"]) == (100, 50, "failed", "success")


def test_resume_writes_only_what_is_missing(spark, out):
    source = spark.range(1000).selectExpr("IF(id = 999, NULL, id * id) AS k", "id AS v")
    assert jobs.copy_in_chunks(source, out, "k", 4) == 4
    remove(spark, f"{out}/rows/chunk=3/_SUCCESS")
    assert jobs.copy_in_chunks(source, out, "k", 4) == 1
    assert jobs.copy_in_chunks(source, out, "k", 4) == 0
    got = jobs.read_chunks(spark, out)
    assert got.count() == 1000 and got.exceptAll(source).count() == 0


def sql_spec(out, **more):
    base = dict(
        kind="sql_import",
        name="parts by brand",
        source_tables=["t"],
        target=Endpoint("csv", path=f"{out}/reports/any.csv"),
        sql="SELECT part, brand, size FROM t WHERE brand = {{brand}} ORDER BY size DESC;",
        params=[ParamDef("brand", required=True)],
    )
    return spec(out, **{**base, **more})


PARTS = "SELECT id AS part, concat('Brand', id % 2) AS brand, id * 7 AS size FROM range(5)"


def test_preview_pages(spark, out):
    save(spark, out, PARTS)
    page = preview_job(spark, sql_spec(out), {"brand": "Brand0"}, 3, 1)
    assert (page.columns, page.total, page.page, page.page_size) == (["part", "brand", "size"], 3, 3, 1)
    assert [tuple(r) for r in page.rows.collect()] == [(0, "Brand0", 0)]
    empty = preview_job(spark, sql_spec(out), {"brand": "none"}, 0, 999)
    assert (empty.total, empty.rows.count(), empty.page, empty.page_size) == (0, 0, 1, 999)
    with pytest.raises(ValueError, match="largest"):
        preview_job(spark, sql_spec(out), {"brand": "none"}, 1, 999, largest=200)
    named = preview_job(spark, sql_spec(out), {"brand": "Brand0"}, 1, 2, order_by=["part"])
    assert [r["part"] for r in named.rows.collect()] == [0, 2]


def test_export_and_import(spark, out):
    save(spark, out, PARTS)
    path = export_job(spark, sql_spec(out), {"brand": "Brand1"}, "Excel ")
    assert "/reports/parts-by-brand-preview-" in path and path.endswith(".csv")
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == [("1", "Brand1", "7"), ("3", "Brand1", "21")]
    result = jobs.run_job(spark, sql_spec(out), out, {"brand": "Brand0"})
    assert (result.status, result.rows) == ("success", 3) and latest_run(spark, out)["file_path"] == result.file_path


def test_only_file_sql_jobs_have_results(spark, out):
    assert eligible(sql_spec(out)) and eligible(sql_spec(out, target=Endpoint("")))
    assert not eligible(spec(out)) and not eligible(sql_spec(out, target=Endpoint("mysql")))
    with pytest.raises(ValueError):
        preview_job(spark, spec(out))
    with pytest.raises(ValueError):
        export_job(spark, sql_spec(out), fmt="pdf")
    assert jobs.run_job(spark, sql_spec(out, source=Endpoint("csv", path=out)), out).status == "failed"


def test_an_interrupted_commit_is_not_seen(spark, out):
    table = KeyedTable(spark, out, ["k"], buckets=4)
    table.commit(spark.range(20).selectExpr("id AS k", "'a' AS v"))
    spark.range(20).selectExpr("id AS k", "'b' AS v", "1 AS _bucket").write.partitionBy("_bucket").parquet(f"{out}/data/c=unseen")
    assert table.read().where("v = 'b'").count() == 0
    table.merge([spark.range(1).selectExpr("0L AS k")], lambda old: old.selectExpr("k", "'c' AS v"))
    assert table.read().count() == 20 and table.read().where("v = 'c'").count() > 0


def test_range_buckets_keep_recent_keys_together(spark, out):
    table = KeyedTable(spark, out, ["k"], bucket_by=range_bucket("k", 100))
    table.commit(spark.range(1000).selectExpr("id AS k", "'a' AS v"))
    assert table.touched_by(spark.range(950, 1050).selectExpr("id AS k")) == {9, 10}
    table.merge([spark.range(950, 1050).selectExpr("id AS k")], lambda old: old.union(spark.range(1000, 1050).selectExpr("id AS k", "'b' AS v")))
    assert table.read().count() == 1050
    table.commit(table.read())
    assert table.expire() == [0, 1] and table.read().count() == 1050


def test_document_sources_take_json_filters(spark, out):
    spark.sql("SELECT id AS _id, named_struct('b', id % 3) AS a FROM range(30)").write.json(f"{out}/src/t")
    job = spec(out, source=Endpoint("mongodb", path=f"{out}/src"), filter='{"a.b": {"$ne": 1}}')
    result = jobs.run_job(spark, job, out)
    assert (result.status, result.rows, result.quality["source_rows"]) == ("success", 20, 20)
    assert set(jobs.read_target(spark, job.target, "t").columns) == {"_id", "a.b"}
    assert jobs.run_job(spark, spec(out, source=job.source, filter="a = 1"), out).status == "failed"


def test_the_order_of_repeats_need_not_be_copied(spark, out):
    save(spark, out, "SELECT id % 5 AS k, id AS v, -id AS at FROM range(20)")
    maps = [FieldMapping("k", "key"), FieldMapping("v")]
    for order, want in ((["at"], {0, 1, 2, 3, 4}), (["v"], {15, 16, 17, 18, 19})):
        job = spec(out, keys=["k"], order_by=order, write="upsert", mappings=maps, quality=False)
        assert jobs.run_job(spark, job, out).status == "success"
        assert {r["v"] for r in jobs.read_target(spark, job.target, "t", ["key"]).collect()} == want


def test_phases_are_told(spark, out):
    save(spark, out, "SELECT id AS k FROM range(5)")
    told = []
    jobs.run_job(spark, spec(out, kind="both", keys=["k"], quality=False), out, on_progress=lambda *p: told.append(p))
    assert told == [("structure", 0, 0.0), ("data", 0, 0.0), ("done", 5, 100.0)]
    jobs.run_job(spark, spec(out, kind="nope"), out, on_progress=lambda *p: told.append(p))
    assert told[-1] == ("failed", 0, 0.0)


def test_file_chunks_resume(spark, out):
    spark.range(100).repartition(5).write.parquet(f"{out}/in")
    source = spark.read.parquet(f"{out}/in")
    assert 1 <= jobs.copy_files_in_chunks(source, f"{out}/copy", 2) <= 3
    remove(spark, matching(spark, f"{out}/copy/rows/chunk=*")[0])
    assert jobs.copy_files_in_chunks(source, f"{out}/copy", 2) == 1
    assert jobs.copy_files_in_chunks(source, f"{out}/copy", 2) == 0
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/copy/rows").collect()) == list(range(100))


def test_file_chunks_keep_filters_and_partition_columns(spark, out):
    spark.range(100).selectExpr("id", "id % 3 AS p").repartition(4).write.partitionBy("p").parquet(f"{out}/in")
    source = spark.read.parquet(f"{out}/in").where("id < 50").selectExpr("id AS n", "p")
    jobs.copy_files_in_chunks(source, f"{out}/copy", 3)
    got = jobs.read_chunks(spark, f"{out}/copy")
    assert sorted((r["n"], r["p"]) for r in got.collect()) == [(i, i % 3) for i in range(50)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "decimal(12,3)", "double"])
def test_chunks_by_any_orderable_key(spark, out, kind):
    value = "id + 0.125" if "d" not in kind[:2] or kind != "date" else "id"
    made = {"date": "date_add(date'2000-01-01', cast(id as int))", "timestamp": "timestamp_micros(id * 7777777)", "timestamp_ntz": "timestamp_ntz'2000-01-01' + make_interval(0,0,0,0,0,0, id)"}.get(kind, f"cast({value} as {kind})")
    source = spark.range(200).selectExpr(f"{made} AS k", "id AS v")
    jobs.copy_in_chunks(source, out, "k", 4)
    remove(spark, f"{out}/rows/chunk=2")
    assert jobs.copy_in_chunks(source, out, "k", 4) == 1
    assert sorted(r["v"] for r in jobs.read_chunks(spark, out).collect()) == list(range(200))


def test_a_keyed_table_is_the_next_jobs_source(spark, out):
    save(spark, out, "SELECT id AS k, 'a' AS v FROM range(30)")
    first = spec(out, keys=["k"], write="upsert", buckets=3)
    assert jobs.run_job(spark, first, out).status == "success"
    second = spec(out, name="next", source=first.target, target=Endpoint("mongodb", path=f"{out}/third"), keys=["k"], write="replace")
    assert jobs.run_job(spark, second, out).status == "success"
    third = spec(out, name="last", source=second.target, target=Endpoint("parquet", path=f"{out}/fourth"))
    result = jobs.run_job(spark, third, out)
    assert (result.status, result.rows) == ("success", 30)
    assert KeyedTable(spark, f"{out}/dst/t", ["k"])._layout() == {"buckets": 3, "by": "hash"}


def test_another_bucket_count_is_refused_and_none_is_taken_from_the_table(spark, out):
    made = KeyedTable(spark, out, ["k"], buckets=7)
    made.commit(spark.range(50).selectExpr("id AS k", "0 AS v"))
    change = spark.range(20).selectExpr("id AS k", "1 AS v")
    with pytest.raises(ValueError, match="bucketed"):
        KeyedTable(spark, out, ["k"], buckets=16).merge([change], lambda old: change)
    with pytest.raises(ValueError, match="bucketed"):
        KeyedTable(spark, out, ["k"], bucket_by=range_bucket("k", 10)).touched_by(change)
    KeyedTable(spark, out, ["k"]).merge([change], lambda old: M.upsert_settled(old, change, ["k"], True, False))
    got = KeyedTable(spark, out, ["k"]).read()
    assert got.count() == 50 and got.agg({"v": "sum"}).first()[0] == 20


def test_two_writers_lose_nothing(spark, out):
    """The second writer's merge is interrupted by a whole merge of the first, after it has read the table."""
    KeyedTable(spark, out, ["k"], buckets=2).commit(spark.range(4).selectExpr("id AS k", "'old' AS v"))
    one, two = KeyedTable(spark, out, ["k"]), KeyedTable(spark, out, ["k"])
    rows = lambda k, v: spark.createDataFrame([(k, v)], "k long, v string")
    tries = []

    def slow(old):
        if not tries:
            one.merge([rows(1, "one")], lambda o: M.upsert_settled(o, rows(1, "one"), ["k"], True, False))
        tries.append(1)
        return M.upsert_settled(old, rows(2, "two"), ["k"], True, False)

    two.merge([rows(2, "two")], slow)
    assert len(tries) == 2 and {r["k"]: r["v"] for r in two.read().collect()} == {0: "old", 1: "one", 2: "two", 3: "old"}
    added = []

    def slow_add(old):
        if not added:
            one.add(rows(10, "x"), lambda o: rows(10, "x"))
        added.append(1)
        return rows(11, "y")

    two.add(rows(11, "y"), slow_add)
    assert {r["k"] for r in one.read().collect()} == {0, 1, 2, 3, 10, 11}


def test_marks_do_not_depend_on_any_zone(spark, out):
    spark.sql("SELECT id, timestamp'2024-03-01 00:00:00 UTC' + make_interval(0,0,0,0,0,0, id) AS at FROM range(5)").write.parquet(f"{out}/src/t")
    job = spec(out, watermark=Watermark("at", "timestamp"), quality=False)
    was, zone = os.environ.get("TZ"), spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("Asia/Tokyo", "America/New_York"):
            os.environ["TZ"] = tz
            time.tzset()
            spark.conf.set("spark.sql.session.timeZone", tz)
            jobs.set_mark(spark, out, "job", "")
            assert jobs.run_job(spark, job, out).high_water == "2024-03-01T00:00:04.000000Z"
            assert jobs.run_job(spark, job, out).rows == 0
        save(spark, out, "SELECT id, timestamp'2024-03-01 00:00:05 UTC' AS at FROM range(100, 106)", "append")
        assert jobs.run_job(spark, job, out).rows == 6
    finally:
        os.environ.pop("TZ") if was is None else os.environ.__setitem__("TZ", was)
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_structure_of_a_plain_folder(spark, out):
    save(spark, out, "SELECT id AS k, 'x' AS v FROM range(3)")
    assert jobs.run_job(spark, spec(out, kind="structure"), out).status == "success"
    made = spark.read.parquet(f"{out}/dst/t")
    assert made.columns == ["k", "v"] and made.count() == 0
    assert jobs.run_job(spark, spec(out, kind="both", quality=False), out).rows == 3
    save(spark, out, "SELECT id AS k, 'x' AS v, 1 AS more FROM range(3)")
    failed = jobs.run_job(spark, spec(out, kind="structure"), out)
    assert failed.status == "failed" and "key columns" in failed.error


def test_run_listings(spark):
    from rowferry.plans import reports

    runs = spark.sql(
        "SELECT * FROM VALUES (1, 7, 'success', '/a.csv'), (2, 7, 'failed', '/b.csv'), (3, 8, 'success', NULL), (4, 7, 'success', '') AS t(id, task_id, status, file_path)"
    )
    named = spark.sql("SELECT 7 AS id, 'seven' AS name")
    assert [r["id"] for r in reports.job_runs(runs, 7).collect()] == [4, 2, 1]
    assert [r["id"] for r in reports.job_runs(runs, 7, 1).collect()] == [4]
    assert [(r["id"], r["task_name"]) for r in reports.run_report(runs, named, "success").collect()] == [(4, "seven"), (3, None), (1, "seven")]
    got = {r["task_id"]: (r["last_run"], r["last_status"], r["file_path"]) for r in reports.latest_files(runs).collect()}
    assert got == {7: (4, "success", "/a.csv"), 8: (3, "success", None)}
