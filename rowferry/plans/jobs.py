"""Whole jobs: full and incremental copy, structure and SQL jobs, resumable copy, and the run log."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from rowferry.functions.names import export_path, high_water_text
from rowferry.functions.params import parameterised_query
from rowferry.model import Endpoint, JobResult, JobSpec, Watermark
from rowferry.operators import merge as M
from rowferry.operators.filters import after_mark, document_predicate, mark_instant, mark_number, where_all
from rowferry.operators.mapping import column, column_pairs, map_columns
from rowferry.operators.quality import check_quality
from rowferry.operators.shards import MAX_SOURCE_SHARDS, Cuts, balanced_cuts, is_integer_key
from rowferry.plans.store import KeyedTable, append_parquet, as_log_row, copy_ledger, is_keyed, run_log, watermarks
from rowferry.session import Staged, exists, move_in, remove, shared_dir, small_frame
from rowferry.sources import documents, files, jdbc, workbooks

FILE_KINDS = ("csv", "excel")
DOCUMENT_KINDS = ("mongodb",)


def read_endpoint(
    spark: SparkSession, e: Endpoint, table: str, shards: int = 1, key: str = "", max_shards: int = MAX_SOURCE_SHARDS, balanced: bool = False
) -> DataFrame:
    """One table of an endpoint as a DataFrame, also a keyed table an earlier job made; an unknown kind is an error."""
    if e.kind in jdbc.DRIVERS:
        if shards > 1 and key:
            read = jdbc.read_balanced if balanced else jdbc.read_sharded
            return read(spark, e, table, key, shards, max_shards=max_shards)
        return jdbc.read_table(spark, e, table)
    at = f"{e.path}/{table}" if table else e.path
    if e.kind in ("parquet", "mongodb") and is_keyed(spark, at):
        return KeyedTable(spark, at, ()).read()
    if e.kind == "csv":
        return files.read_csv(spark, at)
    if e.kind == "excel":
        return workbooks.read_workbooks(spark, e.path, table)
    if e.kind == "mongodb":
        return documents.read_documents(spark, at)
    if e.kind == "parquet":
        return files.read_parquet(spark, at)
    raise ValueError(f"unknown endpoint kind: {e.kind}")


def high_water(df: DataFrame, mark: Watermark) -> str:
    """The highest mark of the rows given, as text; blank when there is none.

    Instants come to the driver as microseconds and zone-free times as text, so
    neither the driver's nor the session's zone can shift them.
    """
    kind, top = df.schema[mark.column].dataType, F.max(column(mark.column))
    if isinstance(kind, T.TimestampType):
        hi = df.agg(F.unix_micros(top).alias("hi")).first()["hi"]
        return "" if hi is None else high_water_text(datetime(1970, 1, 1) + timedelta(microseconds=hi))
    if mark.kind == "timestamp":
        hi = df.agg(top.cast("timestamp_ntz").cast("string").alias("hi")).first()["hi"]
        return "" if hi is None else high_water_text(datetime.fromisoformat(hi))
    return high_water_text(df.agg(top.alias("hi")).first()["hi"])


def row_filter(source: DataFrame, spec: JobSpec) -> str | Column:
    """A job's filter: SQL text, or a JSON document filter where the source holds documents."""
    if spec.source.kind in DOCUMENT_KINDS:
        return document_predicate(source.schema, spec.filter)
    return spec.filter


def incremental_batch(source: DataFrame, mark: Watermark, last: str, filter_by: str | Column = "") -> tuple[DataFrame, str]:
    """(rows to copy, new mark): fixed above and below, so the mark describes exactly those rows.

    The upper bound is read first. Rows that appear later lie above it and come
    with the next run.
    """
    base = where_all(source, filter_by)
    hi = high_water(after_mark(base, mark, last), mark)
    if not hi:
        # Nothing lies above the last mark; rows that come meanwhile wait, null marks belong to the first run.
        return base.where(F.lit(False) if last else column(mark.column).isNull()), last
    return after_mark(base, mark, last, hi), hi


def lower_mark(mark: Watermark, value: str) -> str:
    """A stored mark less the overlap."""
    if not value or not mark.overlap:
        return value
    if mark.kind == "id":
        return str(mark_number(value) - mark.overlap)
    return high_water_text(mark_instant(value) - timedelta(seconds=mark.overlap))


def _with_digest(df: DataFrame) -> DataFrame:
    """Rows with 128 bits of their whole content."""
    parts = M.hash_parts(df, df.columns)
    return df.withColumns({"_digest_a": F.xxhash64(*parts), "_digest_b": F.xxhash64(F.lit(7), *parts)})


DIGEST = ["_digest_a", "_digest_b"]


def overlapping_batch(source: DataFrame, mark: Watermark, last: str, seen: DataFrame | None, filter_by: str | Column = "") -> tuple[DataFrame, str, DataFrame]:
    """``(rows to copy, new mark, digests to keep)``: rows above the mark, and those below it, within the overlap, that were not there before.

    ``seen`` holds digests and counts of the rows that earlier runs copied from
    the overlap. A row is known by all its columns, so ties on the mark and rows
    without a key are told apart, and of equal rows as many are copied as are new.
    """
    base, low = where_all(source, filter_by), lower_mark(mark, last)
    upto = high_water(after_mark(base, mark, low), mark) or last
    rows = after_mark(base, mark, low, upto) if upto else base.where(F.lit(False) if last else column(mark.column).isNull())
    marked = _with_digest(rows)
    kept = after_mark(marked.where(column(mark.column).isNotNull()), mark, lower_mark(mark, upto)) if upto else marked.limit(0)
    digests = kept.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n"))
    if seen is None:
        return rows, upto, digests
    fresh = marked.join(seen.select(*DIGEST), DIGEST, "left_anti").drop(*DIGEST)
    # Rows that were there before, but fewer of them.
    again = marked.join(seen, DIGEST).groupBy(*DIGEST, "n").agg(F.first(F.struct(*[column(c) for c in rows.columns])).alias("row"), F.count(F.lit(1)).alias("now"))
    more = again.where("now > n").select("row", F.explode(F.sequence(F.col("n") + 1, F.col("now")))).select("row.*")
    return fresh.unionByName(more), upto, digests


def write_rows(
    df: DataFrame,
    e: Endpoint,
    table: str,
    write: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    buckets: int | None = None,
    connections: int = MAX_SOURCE_SHARDS,
    batch: tuple[str, int] | None = None,
) -> None:
    """Write to a target by strategy: append, skip, upsert or replace.

    ``buckets`` shapes a keyed table when it is made; ``connections`` is how many tasks write to a database at once.
    A ``batch`` (a name and a number that grows) that a keyed table took in before is left alone.
    """
    spark = df.sparkSession
    if write not in ("append", "skip", "upsert", "replace"):
        raise ValueError(f"unknown write strategy: {write}")
    if write != "append" and not keys:
        raise ValueError(f"{write} needs the key columns of the target")
    if e.kind in jdbc.DRIVERS:
        if write == "upsert" and e.kind != "clickhouse":
            jdbc.upsert_rows(df, e, table, keys, order_by)
        elif write == "skip":
            jdbc.append_rows(M.insert_skip(jdbc.read_table(spark, e, table), df, keys, order_by), e, table, connections)
        elif write == "replace":
            raise ValueError("replace is for document targets")
        else:
            jdbc.append_rows(df, e, table, connections)
        return
    at = f"{e.path}/{table}" if table else e.path
    if e.kind == "csv":
        # Files only ever grow, whatever the strategy.
        files.write_csv(df, at, df.columns)
    elif e.kind == "parquet" and write == "append" and not keys:
        append_parquet(df, at)
    elif e.kind in ("parquet", "mongodb"):
        _write_keyed(df, KeyedTable(spark, at, keys, buckets), write, order_by, batch) if keys else documents.write_documents(df, at)
    else:
        raise ValueError(f"cannot write to endpoint kind: {e.kind}")


def _write_keyed(df: DataFrame, table: KeyedTable, write: str, order_by: Sequence[str], batch: tuple[str, int] | None = None) -> None:
    """Merge into a bucketed table; the input is read several times, so it is staged first.

    Its repeats are settled before staging, and the staged size decides whether
    the merge broadcasts it or shuffles both sides.
    """
    keys = table.keys
    if write == "upsert" or write == "replace":
        df = M.keep_last(df, keys, order_by)
    elif write == "skip":
        df = M.keep_first(df, keys, order_by)
    with Staged(df, "write") as staged:
        fresh = staged.df
        if table.last_commit() < 0:
            table.commit(M.insert_checked(fresh.limit(0), fresh, keys) if write == "append" else fresh, batch=batch)
            return
        if write == "append":
            table.add(fresh, lambda old: M.insert_checked(old, fresh, keys), batch)
        elif write == "skip":
            table.add(fresh, lambda old: M.insert_skip(old, fresh, keys, order_by, M.has_null_keys(fresh, keys)), batch)
        else:
            settle = M.upsert_settled if write == "upsert" else M.replace_settled
            nulls = M.has_null_keys(fresh, keys)
            table.merge([fresh], lambda old: settle(old, fresh, keys, staged.small, nulls), batch, placed=staged.small)


def read_target(spark: SparkSession, e: Endpoint, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """A target as a DataFrame, whichever way ``write_rows`` laid it out."""
    if e.kind in ("parquet", "mongodb") and keys:
        return KeyedTable(spark, f"{e.path}/{table}" if table else e.path, keys).read()
    return read_endpoint(spark, e, table)


def copy_plan(source: DataFrame, spec: JobSpec, last: str = "") -> tuple[DataFrame, str]:
    """(filtered and mapped rows, new mark) of a data job, as one lazy plan.

    Input repeats are settled before the mapping where it leaves out a column
    that orders them; otherwise the write does that.
    """
    if spec.watermark:
        rows, mark = incremental_batch(source, spec.watermark, last, row_filter(source, spec))
    else:
        rows, mark = where_all(source, row_filter(source, spec)), ""
    if spec.keys and not _order_is_copied(source, spec):
        keep = M.keep_first if spec.write == "skip" else M.keep_last
        rows = keep(rows, spec.keys, spec.order_by) if spec.write != "append" else rows
    return map_columns(rows, spec.mappings), mark


def _order_is_copied(source: DataFrame, spec: JobSpec) -> bool:
    copied = {a for a, _ in column_pairs(spec.mappings, source.columns)}
    return all(c in copied for c in spec.order_by)


def last_mark(spark: SparkSession, root: str, job: str) -> str:
    """The stored mark of a job; blank means the next run copies everything."""
    row = watermarks(spark, root).latest().where(F.col("job") == job).first()
    return row["value"] if row else ""


def set_mark(spark: SparkSession, root: str, job: str, value: str) -> None:
    """Store a mark; a blank value starts the job over."""
    seq = int(datetime.now(timezone.utc).timestamp() * 1_000_000)
    watermarks(spark, root).append({"job": job, "seq": seq, "value": value})


def run_job(
    spark: SparkSession,
    spec: JobSpec,
    root: str,
    runtime: Mapping[str, str] | None = None,
    triggered_by: str = "manual",
    on_progress: Callable[[str, int, float], None] | None = None,
) -> JobResult:
    """Run one job to its end and log it below ``root``.

    A failure is logged and returned as a result, not raised; the mark moves
    only after a success, and quality trouble never fails the run.
    ``on_progress`` hears of each phase with the rows so far and the percentage.
    """
    tell = on_progress or (lambda phase, rows, percent: None)
    log = run_log(spark, root)
    run = uuid.uuid4().hex
    started = _now()
    log.append({"run_id": run, "job": spec.name, "seq": 0, "start_time": started, "status": "running", "triggered_by": triggered_by})
    result = JobResult(run, spec.name, "success")
    try:
        _dispatch(spark, spec, root, runtime, result, started, tell)
    except Exception as error:  # noqa: BLE001 - any failure belongs in the log
        result.status, result.error = "failed", str(error)
    if result.status == "success" and spec.watermark and result.high_water:
        set_mark(spark, root, spec.name, result.high_water)
    log.append(
        as_log_row(result, seq=1, start_time=started, end_time=_now(), triggered_by=triggered_by, **({} if result.error else result.quality))
    )
    failed = result.status != "success"
    tell("failed" if failed else "done", result.rows, 0.0 if failed else 100.0)
    return result


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _dispatch(spark: SparkSession, spec: JobSpec, root: str, runtime, result: JobResult, started: datetime, tell) -> None:
    if spec.kind not in ("structure", "data", "both", "sql_import"):
        raise ValueError(f"unknown job kind: {spec.kind}")
    if spec.kind == "sql_import":
        tell("data", 0, 0.0)
        _sql_import(spark, spec, runtime, result, started)
        return
    key = spec.keys[0] if len(spec.keys) == 1 else ""
    source = read_endpoint(spark, spec.source, spec.source_table, spec.shards, key, spec.max_shards, spec.balanced)
    if spec.kind in ("structure", "both"):
        tell("structure", 0, 0.0)
        _structure(spark, spec, source)
    if spec.kind in ("data", "both"):
        tell("data", 0, 0.0)
        last = last_mark(spark, root, spec.name) if spec.watermark else ""
        if spec.watermark and spec.watermark.overlap:
            result.rows, result.high_water = _copy_overlap(spark, source, spec, root, last)
        elif spec.chunks:
            last, result.high_water, result.rows = _copy_by_ledger(spark, source, spec, root, last, tell)
        else:
            rows, result.high_water = copy_plan(source, spec, last)
            result.rows = _write_counted(rows, spec)
        if spec.quality:
            result.quality = _quality(spark, spec, source, last, result.high_water)


def _copy_overlap(spark: SparkSession, source: DataFrame, spec: JobSpec, root: str, last: str) -> tuple[int, str]:
    """An incremental copy that looks again below its mark; the digests it goes by are kept under the mark they belong to."""
    if spec.chunks:
        raise ValueError("a copy in chunks cannot overlap earlier ones")

    def kept(mark: str) -> str:
        return f"{root}/seen/{spec.name}/{hashlib.sha256(mark.encode()).hexdigest()[:32]}"

    seen = spark.read.parquet(kept(last)) if last and exists(spark, f"{kept(last)}/_SUCCESS") else None
    picked, upto, digests = overlapping_batch(source, spec.watermark, last, seen, row_filter(source, spec))
    with Staged(digests, "digests") as fresh:  # read before the write and kept after it, as the mark is
        written = _write_counted(copy_plan(picked, replace(spec, watermark=None, filter=""))[0], spec)
        if upto:
            fresh.df.write.mode("overwrite").parquet(kept(upto))
    if last and upto != last:
        remove(spark, kept(last))
    return written, upto


# Numbers of one copy's chunks stay below this, so a later copy's are all larger.
_CHUNKS = 1 << 20


def _copy_by_ledger(spark: SparkSession, source: DataFrame, spec: JobSpec, root: str, last: str, tell) -> tuple[str, str, int]:
    """A data job chunk by chunk; ``(lower mark, new mark, rows)`` once all chunks are in the target.

    The ledger below ``root`` keeps the copy's marks and range edges from its
    first run, so a later run copies the same rows, and notes each chunk that
    is in. A chunk that was written but not noted is recognised: a keyed table
    keeps the number of the last chunk with its commit, and files of a plain
    target are written aside and moved in under names of their own. In a
    database only an upsert can be repeated without harm, so others are refused.
    """
    key = spec.chunk_key or (spec.keys[0] if spec.keys else spec.watermark.column if spec.watermark else "")
    if not key:
        raise ValueError("a copy in chunks needs a chunk_key")
    if spec.target.kind in jdbc.DRIVERS and spec.write != "upsert":
        raise ValueError("a copy in chunks into a database needs write='upsert'")
    ledger = copy_ledger(spark, root)
    plans = ledger.all().where((F.col("job") == spec.name) & F.col("chunk").isNull()).orderBy("seq").collect()
    now = int(datetime.now(timezone.utc).timestamp() * 1_000_000)
    if plans and plans[-1]["state"] == "planned":
        plan = plans[-1].asDict()
    else:
        upto = incremental_batch(source, spec.watermark, last, row_filter(source, spec))[1] if spec.watermark else ""
        cuts = balanced_cuts(where_all(source, row_filter(source, spec)), key, min(spec.chunks, _CHUNKS - 1))
        plan = {"job": spec.name, "seq": now, "copy": (plans[-1]["copy"] if plans else 0) + 1, "state": "planned", "low_mark": last, "high_mark": upto, "edges": json.dumps(cuts.edges)}
        ledger.append(plan)
    copy, last, upto = plan["copy"], plan["low_mark"], plan["high_mark"]
    done = {r["chunk"]: r["rows"] for r in ledger.all().where((F.col("job") == spec.name) & (F.col("copy") == copy) & F.col("chunk").isNotNull()).collect()}
    ranges = Cuts(tuple(json.loads(plan["edges"]))).predicates(key)
    for chunk, inside in enumerate(ranges):
        if chunk not in done:
            done[chunk] = _write_chunk(spark, source.where(inside), spec, root, last, upto, copy, chunk)
            ledger.append({"job": spec.name, "seq": now + chunk + 1, "copy": copy, "chunk": chunk, "state": "written", "rows": done[chunk]})
        tell("data", sum(done.values()), 100.0 * len(done) / len(ranges))
    if spec.watermark and upto:
        set_mark(spark, root, spec.name, upto)
    ledger.append({**plan, "seq": max(now, plan["seq"]) + len(ranges) + 1, "state": "whole", "rows": sum(done.values())})
    return last, upto, sum(done.values())


def _write_chunk(spark: SparkSession, part: DataFrame, spec: JobSpec, root: str, last: str, upto: str, copy: int, chunk: int) -> int:
    """Bring one chunk into the target exactly once, whatever an earlier attempt left; its number of rows."""
    rows = _chunk_rows(part, spec, last, upto)
    if spec.target.kind in ("parquet", "csv", "mongodb") and not spec.keys:
        aside = f"{root}/chunks/{spec.name}/copy={copy}/chunk={chunk}"
        if not exists(spark, f"{aside}/counted/_SUCCESS"):
            counted, seen = _counting(rows)
            staged = replace(spec, target=Endpoint(spec.target.kind, path=f"{aside}/files"), target_table="")
            remove(spark, f"{aside}/files")
            _write_counted(counted, staged)
            small_frame(spark, [(seen.get.get("n", 0),)], "n long").write.mode("overwrite").parquet(f"{aside}/counted")
        n = spark.read.schema("n long").parquet(f"{aside}/counted").first()["n"]
        at = f"{spec.target.path}/{spec.target_table}" if spec.target_table else spec.target.path
        move_in(spark, f"{aside}/files", at, f"copy-{spec.name}-{copy}-{chunk}".replace("/", "_"))
        return n
    return _write_counted(rows, spec, (f"copy:{spec.name}", copy * _CHUNKS + chunk))


def _chunk_rows(part: DataFrame, spec: JobSpec, last: str, upto: str) -> DataFrame:
    """A chunk's rows between the copy's marks, mapped; repeats of a key are settled as in a copy at one go."""
    rows = where_all(part, row_filter(part, spec))
    if spec.watermark:
        rows = after_mark(rows, spec.watermark, last, upto) if upto else rows.where(F.lit(False) if last else column(spec.watermark.column).isNull())
    return copy_plan(rows, replace(spec, watermark=None, filter=""))[0]


def _counting(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, counted on their way into a write instead of by a second scan."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _write_counted(rows: DataFrame, spec: JobSpec, batch: tuple[str, int] | None = None) -> int:
    counted, seen = _counting(rows)
    names = {m.source: m.name for m in spec.mappings if m.enabled}
    keys = [names.get(k, k) for k in spec.keys]
    order = [names.get(c, c) for c in spec.order_by]
    order = order if all(c in rows.columns for c in order) else []
    write_rows(counted, spec.target, spec.target_table, spec.write, keys, order, spec.buckets, spec.connections, batch)
    return seen.get.get("n", 0)


def _structure(spark: SparkSession, spec: JobSpec, source: DataFrame) -> None:
    from rowferry.operators import schema as S

    table = spec.target_table
    if spec.source.kind in jdbc.DRIVERS:
        columns = jdbc.describe_tables(spark, spec.source, [spec.source_table])
    else:
        columns = S.describe({table: source}, "spark", {table: list(spec.keys)})
    columns = columns.withColumn("table", F.lit(table))
    mappings = S.mapping_frame(spark, {table: spec.mappings}) if spec.mappings else None
    if spec.target.kind == "parquet" and spec.keys:
        names = dict(column_pairs(spec.mappings, source.columns))
        keyed = KeyedTable(spark, f"{spec.target.path}/{table}" if table else spec.target.path, [names.get(k, k) for k in spec.keys], spec.buckets)
        keyed.sync_structure(columns, mappings, spec.allow_drop)
        return
    if spec.target.kind == "parquet":
        at = f"{spec.target.path}/{table}" if table else spec.target.path
        wanted = S.apply_mappings(columns, mappings)
        if not exists(spark, at):
            append_parquet(S.empty_like(spark, wanted), at)
            return
        current = S.describe({table: read_endpoint(spark, spec.target, table)}, "spark", {})
        diffs = S.schema_diff(S.as_spark_types(wanted), current, "spark")
        if not diffs.where("action <> 'drop'").isEmpty() or (spec.allow_drop and not diffs.isEmpty()):
            raise ValueError("a plain parquet folder cannot be reshaped in place; give the target's key columns")
        return
    if spec.target.kind not in jdbc.DRIVERS:
        return  # other file and document targets take the structure of what is written
    if spec.source.kind not in jdbc.DRIVERS:
        jdbc.create_like(map_columns(source, spec.mappings), spec.target, table)
        return
    jdbc.sync_structure(spark, columns, spec.target, table, mappings, spec.allow_drop)


def _quality(spark: SparkSession, spec: JobSpec, source: DataFrame, last: str, upto: str) -> dict:
    """The check after a copy. Its own error fails no run; the log says what it was."""
    try:
        picked = where_all(source, row_filter(source, spec))
        if spec.watermark:
            picked = after_mark(picked, spec.watermark, last, upto)
        pairs = column_pairs(spec.mappings, source.columns)
        names = dict(pairs)
        target = read_target(spark, spec.target, spec.target_table, [names.get(k, k) for k in spec.keys])
        keys = [k for k in spec.keys if k in names and is_integer_key(source, k)]
        # A database counts its own rows; one number comes over the wire.
        whole = not spec.filter and not spec.watermark
        counted = (
            jdbc.count_rows(spark, spec.source, spec.source_table) if whole and spec.source.kind in jdbc.DRIVERS else None,
            jdbc.count_rows(spark, spec.target, spec.target_table) if spec.target.kind in jdbc.DRIVERS else None,
        )
        usable = keys if len(keys) == 1 == len(spec.keys) else ()
        row = check_quality(picked, target, pairs, usable, counted=counted).first().asDict()
        row["quality_status"] = row.pop("status")
        return row
    except Exception as error:  # noqa: BLE001 - the copy is done, whatever the check runs into
        return {"quality_status": "error", "error_msg": f"quality check: {error}"}


def verify_job(spark: SparkSession, spec: JobSpec, root: str) -> dict:
    """Check a job's source against its target without its filter, and note the outcome on its newest run."""
    source = read_endpoint(spark, spec.source, spec.source_table)
    outcome = _quality(spark, replace(spec, filter="", watermark=None), source, "", "")
    log = run_log(spark, root)
    newest = log.latest().where(F.col("job") == spec.name).orderBy(F.col("start_time").desc()).first()
    if newest and outcome:
        log.append({**newest.asDict(), **outcome, "seq": newest["seq"] + 1})
    return outcome


def _sql_import(spark: SparkSession, spec: JobSpec, runtime, result: JobResult, started: datetime) -> None:
    if not spec.sql.strip():
        raise ValueError("source SQL must not be empty")
    if spec.source.kind in FILE_KINDS + DOCUMENT_KINDS:
        raise ValueError("a SQL import needs a SQL source")
    rows = query_rows(spark, spec, runtime)
    if spec.target.kind in (*FILE_KINDS, ""):
        # No target means a CSV export too.
        result.file_path = export_path(spec.target.path or shared_dir(spark), spec.name, started)
        counted, seen = _counting(rows)
        files.write_csv(counted, result.file_path, rows.columns)
        result.rows = seen.get.get("n", 0)
        return
    result.rows = _write_counted(rows, replace(spec, mappings=()))


def view_name(table: str) -> str:
    """The name a source table goes by in a job's SQL: no folder, no schema, no file suffix."""
    base = table.rsplit("/", 1)[-1]
    for suffix in (".parquet", ".csv", ".json"):
        base = base.removesuffix(suffix)
    return base.rsplit(".", 1)[-1]


def query_rows(spark: SparkSession, spec: JobSpec, runtime: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of a job's SQL: its source tables become views and Spark runs the query over them.

    Filters and columns of the query still push down to the source; only bind
    values, never row data, go through the driver.
    """
    for table in spec.source_tables:
        read_endpoint(spark, spec.source, table).createOrReplaceTempView(view_name(table))
    return parameterised_query(spark, spec.sql, spec.params, runtime)


def copy_in_chunks(
    source: DataFrame,
    path: str,
    key: str,
    chunks: int = 16,
    mappings: Sequence = (),
) -> int:
    """A copy that resumes: key-range chunks, each its own committed folder; returns chunks written now.

    Chunk edges are quantiles of the key, kept with the copy at its first run,
    so chunks hold like numbers of rows and a later run means the same ranges.
    Chunks whose folder carries the commit marker are skipped. Each chunk is one
    filtered scan, so this suits sources that find a key range by index or by
    sorted files; ``copy_files_in_chunks`` suits unsorted files. The key may be
    of any type that has quantiles: numbers, decimals, dates and timestamps.
    """
    spark = source.sparkSession
    edges_at = f"{path}/edges"
    if not exists(spark, f"{edges_at}/_SUCCESS"):
        kind = source.schema[key].dataType
        quantiles = F.percentile_approx(column(key), [i / chunks for i in range(1, chunks)] or [1.0], 10_000)
        cut = F.array_sort(F.array_distinct(quantiles)) if chunks > 1 else F.array().cast(T.ArrayType(kind))
        source.agg(F.coalesce(cut, F.array().cast(T.ArrayType(kind))).alias("edges")).coalesce(1).write.mode("overwrite").parquet(edges_at)
    # Each edge as text that gives the same value back whatever the zone.
    kind = source.schema[key].dataType
    instant = isinstance(kind, T.TimestampType)
    stored = spark.read.parquet(edges_at).select(F.transform("edges", lambda x: (F.unix_micros(x) if instant else x).cast("string")).alias("edges"))
    edges = [F.timestamp_micros(F.lit(int(x))) if instant else F.lit(x).cast(kind) for x in stored.first()["edges"]]
    c, written = column(key), 0
    for i in range(len(edges) + 1):
        out = f"{path}/rows/chunk={i}"
        if exists(spark, f"{out}/_SUCCESS"):
            continue
        part = source
        if i:
            part = part.where(c >= edges[i - 1])
        if i < len(edges):
            part = part.where((c < edges[i]) if i else ((c < edges[i]) | c.isNull()))
        elif not i:
            part = source
        map_columns(part, mappings).write.mode("overwrite").parquet(out)
        written += 1
    return written


def copy_files_in_chunks(source: DataFrame, path: str, files_per_chunk: int = 1000, mappings: Sequence = ()) -> int:
    """The resumable copy of a parquet table in chunks of its files, so no file is read twice.

    Each chunk is the source's own plan, with its filters and partition columns,
    held to some of its files, about ``files_per_chunk``, whose names are all
    that the driver sees at a time. The file list of the first run is kept with
    the copy; files that appear later belong to a later copy.
    """
    spark = source.sparkSession
    list_at = f"{path}/files"
    if not exists(spark, f"{list_at}/_SUCCESS"):
        names = source.select(F.col("_metadata.file_path").alias("file")).distinct()
        chunks = max(1, -(-names.count() // files_per_chunk))
        names.select(F.pmod(F.xxhash64("file"), F.lit(chunks)).cast("int").alias("chunk"), "file").write.mode("overwrite").parquet(list_at)
    planned = spark.read.parquet(list_at)
    written = 0
    for (chunk,) in planned.select("chunk").distinct().orderBy("chunk").collect():
        out = f"{path}/rows/chunk={chunk}"
        if exists(spark, f"{out}/_SUCCESS"):
            continue
        names = [r["file"] for r in planned.where(F.col("chunk") == chunk).collect()]
        part = source.where(F.col("_metadata.file_path").isin(names))
        map_columns(part, mappings).write.mode("overwrite").parquet(out)
        written += 1
    return written


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("chunk")
