"""Keep a keyed table in step with a change feed, one micro-batch at a time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rowferry.model import FieldMapping, JobSpec
from rowferry.operators.changes import fold_events, map_feed, settle, split_feed
from rowferry.operators.keyless import ROW_KEY, as_bag, bag_fields, deleted_keys, merge_bag, surviving_inserts
from rowferry.operators.mapping import rename_feed
from rowferry.operators.relations import read_messages, relation_messages, split_read, versions, widen
from rowferry.plans.jobs import run_job
from rowferry.plans.store import KeyedTable, LostClaim
from rowferry.session import Staged, exists, small_frame


def feed_schema(row: T.StructType, before: T.StructType | None = None, unchanged: bool = False) -> T.StructType:
    """The schema of a feed of one table whose rows look like ``row``."""
    fields = [
        T.StructField("seq", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("before", before or row),
        T.StructField("after", row),
    ]
    if unchanged:
        fields.append(T.StructField("unchanged", T.ArrayType(T.StringType())))
    return T.StructType(fields)


def read_feed(spark: SparkSession, path: str, schema: T.StructType, table: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """A streaming feed of one table from a folder of files; unreadable records are kept as such."""
    if fmt == "json":
        full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        reader = spark.readStream.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        feed = reader.option("maxFilesPerTrigger", max_files).json(path)
        return feed.where((F.col("table") == table) | F.col("_corrupt_record").isNotNull())
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
    return feed.where(F.col("table") == table)


def replicate(
    feed: DataFrame,
    target: KeyedTable,
    checkpoint: str,
    dead_letter: str,
    mode: str = "strict",
    mappings: Sequence[FieldMapping] = (),
    name: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start applying a feed to a table that already holds its first load.

    Each micro-batch is one commit of the table that notes the batch, so a batch
    that runs again after a crash is recognised and skipped, also when other
    jobs wrote to the table meanwhile. Only the buckets its keys fall into are
    rewritten. Bad events go to ``dead_letter``
    with their reason and the feed goes on. The checkpoint resumes where the
    last run stopped. One query per name runs at a time: a new start stops the
    old one.
    """
    spark = feed.sparkSession
    if name:
        for running in spark.streams.active:
            if running.name == name:
                running.stop()
    if target.last_commit() < 0:
        raise ValueError("the target table needs its first load before the feed")
    stream = _stream_id(spark, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= target.applied(stream):
            return
        renamed = map_feed(batch, mappings) if mappings else batch
        held = renamed.persist()
        try:
            good, bad = split_feed(held, target.keys, target.schema())
            _reject(bad, dead_letter, batch_id)
            _merge_feed(target, good, mode, (stream, batch_id))
        finally:
            held.unpersist()

    return _start(feed, apply, checkpoint, name, trigger)


def _reject(bad: DataFrame, dead_letter: str, batch_id: int) -> None:
    rejects = bad.select(F.lit(batch_id).cast("long").alias("batch_id"), "reason", F.to_json(F.struct(*bad.drop("reason").columns)).alias("event"))
    if not rejects.isEmpty():
        rejects.write.mode("overwrite").json(f"{dead_letter}/batch={batch_id}")


def _merge_feed(target: KeyedTable, good: DataFrame, mode: str, batch: tuple[str, int], fields: Sequence[T.StructField] = ()) -> None:
    """One commit of a batch's good events; ``fields`` are columns the target gets if it lacks them."""
    sides = [s for s in ("before", "after") if s in good.columns]
    images = [good.where(F.col(s).isNotNull()).select(f"{s}.*") for s in sides]
    keyed = [i.select(*target.keys) for i in images if all(k in i.columns for k in target.keys)]
    # What the batch amounts to is staged: one row per key, of a size that is then known.
    with Staged(fold_events(good, target.keys, mode), "batch") as folded:
        image = good.schema["after"].dataType
        target.merge(keyed, lambda old: settle(widen(old, fields), folded.df, target.keys, image, mode, folded.small), batch, folded.small)


def _start(feed: DataFrame, apply, checkpoint: str, name: str | None, trigger: dict | None) -> StreamingQuery:
    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/query")
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def replicate_messages(
    messages: DataFrame,
    target: KeyedTable,
    table: str,
    checkpoint: str,
    dead_letter: str,
    mode: str = "strict",
    name: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Follow a feed of bare values with schema messages among them (see ``relations``).

    Schema messages are kept beside the checkpoint, by batch, so events of a
    later batch or after a restart are read by the version valid for them. A
    batch that runs again writes the same folder and is then recognised by the
    table's commit. Columns a message adds are columns of the target from that
    batch on.
    """
    spark = messages.sparkSession
    if target.last_commit() < 0:
        raise ValueError("the target table needs its first load before the feed")
    stream = _stream_id(spark, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= target.applied(stream):
            return
        at = f"{checkpoint}/relations"
        relation_messages(batch).repartition(1).write.mode("overwrite").parquet(f"{at}/batch={batch_id}")
        with Staged(versions(spark.read.parquet(at).where(F.col("batch") <= batch_id).drop("batch")), "relations") as known:
            read, fields = read_messages(batch, known, table, target.keys, target.schema())
            # Events are read once; every step after that takes what it needs of the outcome.
            with Staged(read, "events") as events:
                good, bad = split_read(events.df)
                _reject(bad, dead_letter, batch_id)
                _merge_feed(target, good, mode, (stream, batch_id), fields)

    return _start(messages, apply, checkpoint, name, trigger)


def load_keyless(rows: DataFrame, path: str, buckets: int | None = None) -> KeyedTable:
    """The first load of a table without a key, kept as a bag (see ``keyless``)."""
    target = KeyedTable(rows.sparkSession, path, [ROW_KEY], buckets)
    target.commit(as_bag(rows, rows.columns))
    return target


def replicate_keyless(
    feed: DataFrame, target: KeyedTable, checkpoint: str, dead_letter: str, name: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Follow a feed of a table without a key: inserts add rows, deletes take all older rows they name, updates are skipped.

    Each micro-batch is one commit of the bag that notes the batch, so one that
    runs again is recognised and skipped. Deletes are looked up in the bag's
    distinct rows; only the buckets of rows that go or come are rewritten.
    """
    spark = feed.sparkSession
    if target.last_commit() < 0:
        raise ValueError("the target table needs its first load before the feed")
    stream = _stream_id(spark, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            good, bad = split_feed(held, [], target.schema())
            _reject(bad, dead_letter, batch_id)
            fields = bag_fields(target.schema(), good.schema["after"].dataType)
            with Staged(surviving_inserts(good, fields), "added") as added:
                while True:
                    base = target.last_commit()
                    if batch_id <= target.applied(stream):
                        return
                    with Staged(deleted_keys(target.read(), good), "gone") as gone:
                        touched = target.touched_by(gone.df, added.df)
                        try:
                            target.commit(merge_bag(target.read(touched), gone.df, added.df), touched, (stream, batch_id), base=base)
                            return
                        except LostClaim:
                            continue
        finally:
            held.unpersist()

    return _start(feed, apply, checkpoint, name, trigger)


def start_realtime(
    spark: SparkSession,
    spec: JobSpec,
    feed: DataFrame,
    root: str,
    mode: str = "strict",
    initial_load: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """A realtime job: the target is loaded once from the source, then follows the feed.

    The feed must reach back to before the load; in ``upsert`` mode events the
    load already holds do no harm. Without ``initial_load`` the target starts
    empty, in the feed's own structure. Checkpoint and rejects live below
    ``root`` under the job's name, and so does the run log the load writes to.
    """
    names = {m.source: m.name for m in spec.mappings if m.enabled}
    at = f"{spec.target.path}/{spec.target_table}" if spec.target_table else spec.target.path
    target = KeyedTable(spark, at, [names.get(k, k) for k in spec.keys], spec.buckets)
    if target.last_commit() < 0 and initial_load:
        load = run_job(spark, replace(spec, kind="data", write="append", watermark=None), root, triggered_by="realtime")
        if load.status != "success":
            raise RuntimeError(load.error)
    elif target.last_commit() < 0:
        image = feed.schema["after"].dataType
        kept = rename_feed(image.names, spec.mappings)
        fields = [T.StructField(kept[f.name], f.dataType) for f in image.fields if f.name in kept]
        target.commit(spark.createDataFrame([], T.StructType(fields)))
    return replicate(
        feed,
        target,
        f"{root}/checkpoints/{spec.name}",
        f"{root}/dead_letter/{spec.name}",
        mode,
        spec.mappings,
        name=spec.name,
        trigger=trigger,
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The name a checkpoint goes by in the tables it feeds; a new checkpoint counts its batches anew."""
    at = f"{checkpoint}/stream"
    if not exists(spark, f"{at}/_SUCCESS"):
        small_frame(spark, [(uuid.uuid4().hex,)], "id string").write.mode("overwrite").json(at)
    return spark.read.schema("id string").json(at).first()["id"]


def stop_all(spark: SparkSession) -> None:
    for query in spark.streams.active:
        query.stop()


def is_running(spark: SparkSession, name: str) -> bool:
    return any(q.name == name and q.isActive for q in spark.streams.active)
