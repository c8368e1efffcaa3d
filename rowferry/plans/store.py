"""Targets kept as parquet folders, and the small state tables of jobs.

A keyed table is split into buckets by its key. A commit writes new files only
for the buckets it touched, in a folder of its own, and becomes visible when the
list of those buckets is written; readers take each bucket's last rewrite and
the additions since. Nothing is overwritten in place, so a failed or repeated
job harms no reader. A writer claims the commit that follows the one it read by
making a file that must not exist yet; one that comes second reads and merges
anew, so no writer's rows are lost.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowferry.model import COPY_SCHEMA, RUN_LOG_SCHEMA, WATERMARK_SCHEMA, JobResult
from rowferry.operators.mapping import column
from rowferry.session import children, create_new, exists, matching, remove, small_frame

BUCKET = "_bucket"
LOG = "bucket int, commit long, added boolean, head string, folder string"
BUCKETS = 16

# How long a claimed commit may take to appear: its data is written before the claim, only its list follows.
CLAIM_SECONDS = 120


class LostClaim(RuntimeError):
    """Another writer claimed the commit first."""


def is_keyed(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a keyed table."""
    return exists(spark, f"{path.rstrip('/')}/commits")


def hash_bucket(df: DataFrame, keys: Sequence[str], n: int) -> Column:
    """Spread keys evenly over ``n`` buckets.

    Hashes the text of a key, so an int and a bigint of one value agree, and
    timestamps as instants, so the session's zone does not matter.
    """
    instant = T.TimestampType
    parts = [F.unix_micros(column(k)) if isinstance(df.schema[k].dataType, instant) else column(k).cast("string") for k in keys]
    return F.pmod(F.xxhash64(*parts), F.lit(n)).cast("int")


def range_bucket(key: str, width: int) -> Column:
    """Neighbouring integer keys share a bucket, so changes to recent keys touch few buckets."""
    return F.expr(f"`{key}` div {width}").cast("int")


class KeyedTable:
    """A table with one row per key that merges rewrite bucket by bucket.

    ``buckets`` is fixed when the table is made and kept with it; size it so
    that one bucket is a few hundred MB. Later it may be left out, and another
    number is an error. ``bucket_by`` replaces the key hash by any function of
    the key, such as ``range_bucket`` for keys that grow with time; it must be
    given again each time and be the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int | None = None, bucket_by: Column | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets, self.bucket_by = buckets, bucket_by

    def _layout(self) -> dict:
        """How rows find their bucket: as the table says, which what was asked for must agree with."""
        asked = {"buckets": None, "by": str(self.bucket_by)} if self.bucket_by is not None else {"buckets": self.buckets, "by": "hash"}
        kept = self._head().get("layout")
        if kept is None:
            return asked if asked["buckets"] or self.bucket_by is not None else {"buckets": BUCKETS, "by": "hash"}
        if asked["by"] != kept["by"] or asked["buckets"] not in (None, kept["buckets"]):
            raise ValueError(f"{self.path} is bucketed as {kept}, not as {asked}")
        return kept

    def bucket_of(self, df: DataFrame) -> Column:
        layout = self._layout()
        return hash_bucket(df, self.keys, layout["buckets"]) if self.bucket_by is None else self.bucket_by

    def _commits(self) -> list[int]:
        marks = matching(self.spark, f"{self.path}/commits/c=*/_SUCCESS")
        return sorted(int(m.rsplit("/", 2)[1].partition("=")[2]) for m in marks)

    def last_commit(self) -> int:
        """The newest visible commit, -1 before the first."""
        return max(self._commits(), default=-1)

    def _current(self) -> list[tuple[int, str]]:
        """(bucket, data folder) pairs that make up the table: each bucket's last rewrite and what was added since."""
        done = self._commits()
        if not done:
            return []
        log = self.spark.read.schema(LOG).parquet(*[f"{self.path}/commits/c={c}" for c in done]).where("bucket IS NOT NULL")
        rewrite = F.coalesce(F.max(F.when(~F.col("added"), F.col("commit"))), F.lit(-1))
        state = log.groupBy("bucket").agg(rewrite.alias("base"), F.collect_list(F.struct("commit", "folder")).alias("all"))
        pairs = state.select("bucket", F.explode(F.filter("all", lambda c: c["commit"] >= F.col("base"))).alias("c"))
        return [(r["bucket"], r["folder"]) for r in pairs.select("bucket", "c.folder").collect()]

    def read(self, only: set[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The table as of the newest commit, or just some of its buckets."""
        paths, held = [], {}
        for bucket, name in self._current():
            if only is None or bucket in only:
                folder = f"{self.path}/data/{name}"
                if name not in held:
                    held[name] = set(children(self.spark, folder))
                if f"{BUCKET}={bucket}" in held[name]:
                    paths.append(f"{folder}/{BUCKET}={bucket}")
        if not paths:
            return self.spark.createDataFrame([], schema or self.schema())
        return self.spark.read.schema(schema or self.schema()).parquet(*paths)

    def _head(self) -> dict:
        """What the newest commit recorded: the schema, and the last batch each stream applied."""
        done = self._commits()
        if not done:
            return {}
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/commits/c={done[-1]}")
        return json.loads(log.where("head IS NOT NULL").first()["head"])

    def schema(self) -> T.StructType:
        """The table's schema; an empty table has one too."""
        head = self._head()
        if not head:
            raise ValueError(f"no table at {self.path}")
        return T.StructType.fromJson(head["schema"])

    def applied(self, stream: str) -> int:
        """The last batch of a stream this table took in, -1 for none."""
        return self._head().get("applied", {}).get(stream, -1)

    def touched_by(self, *keyed: DataFrame) -> set[int]:
        """Buckets that hold any of the keys given; at most one number per bucket."""
        types = self.schema()
        typed = [df.select([column(k).cast(types[k].dataType).alias(k) for k in self.keys]) for df in keyed]
        numbers = [df.select(self.bucket_of(df).alias("b")).distinct() for df in typed]
        whole = numbers[0]
        for more in numbers[1:]:
            whole = whole.unionByName(more)
        return {r["b"] for r in whole.distinct().collect() if r["b"] is not None}

    def commit(
        self,
        rows: DataFrame,
        touched: set[int] | None = None,
        batch: tuple[str, int] | None = None,
        placed: bool = False,
        added: bool = False,
        base: int | None = None,
    ) -> int:
        """Write the rows of the touched buckets (all of them by default) as one commit.

        They replace what those buckets held, unless they are ``added`` to it.

        Rows are rebalanced by bucket first: adaptive execution packs small
        buckets together and splits large ones, so files come out of even size.
        ``placed`` rows mostly sit by bucket already (they were read from bucket
        files and not shuffled since) and are written where they are. ``batch``
        notes a stream's (id, batch number) with the commit. Rows made from what
        the table held at commit ``base`` are refused with ``LostClaim`` where
        another commit came meanwhile; without it the rows depend on nothing and
        follow whatever came.
        """
        folder = f"c={uuid.uuid4().hex}"
        data = f"{self.path}/data/{folder}"
        layout = self._layout()
        out = rows.withColumn(BUCKET, self.bucket_of(rows))
        out = out if placed else out.hint("rebalance", F.col(BUCKET))
        out.write.mode("overwrite").partitionBy(BUCKET).parquet(data)
        while True:
            number = (self.last_commit() if base is None else base) + 1
            if create_new(self.spark, f"{self.path}/claims/c={number}"):
                break
            self._await(number)
            if base is not None:
                remove(self.spark, data)
                raise LostClaim(f"commit {number} of {self.path} is another writer's")
        written = {int(n.partition("=")[2]) for n in children(self.spark, data) if n.startswith(f"{BUCKET}=")}
        if touched is None:
            touched = written | (set() if added else {b for b, _ in self._current()})
        applied = self._head().get("applied", {}) | (dict([batch]) if batch else {})
        head = json.dumps({"schema": rows.schema.jsonValue(), "applied": applied, "layout": layout})
        marks = [(b, number, added, None, folder) for b in sorted(touched)] + [(None, number, added, head, folder)]
        small_frame(self.spark, marks, LOG).write.mode("overwrite").parquet(f"{self.path}/commits/c={number}")
        return number

    def _await(self, number: int) -> None:
        """Until a claimed commit is visible; a claim whose writer died is an error that names the file to remove."""
        end = time.monotonic() + CLAIM_SECONDS
        while number not in self._commits():
            if time.monotonic() > end:
                raise RuntimeError(f"the writer of commit {number} did not finish; if it is gone, remove {self.path}/claims/c={number}")
            time.sleep(0.2)

    def merge(
        self,
        touched_keys: Sequence[DataFrame],
        make: Callable[[DataFrame], DataFrame],
        batch: tuple[str, int] | None = None,
        placed: bool = False,
    ) -> int:
        """Rewrite the buckets of some keys: ``make`` turns their old rows into their new rows.

        A stream's batch that was applied before is left alone, so running it
        again is harmless.
        """
        while True:
            base = self.last_commit()
            if batch is not None and batch[1] <= self.applied(batch[0]):
                return base
            touched = self.touched_by(*touched_keys)
            try:
                return self.commit(make(self.read(touched)), touched, batch, placed, base=base)
            except LostClaim:
                continue

    def add(self, keyed: DataFrame, make: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Add rows beside the old ones: ``make`` gets the old rows near the given keys and returns just the new ones."""
        while True:
            base = self.last_commit()
            if batch is not None and batch[1] <= self.applied(batch[0]):
                return base
            old = self.read(self.touched_by(keyed))
            fresh = make(old).select([column(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields])
            try:
                return self.commit(fresh, batch=batch, added=True, base=base)
            except LostClaim:
                continue

    def sync_structure(self, columns: DataFrame, mappings: DataFrame | None = None, allow_drop: bool = False) -> int:
        """Bring the table to a catalog's structure: make it empty, or add, cast and (if allowed) drop columns."""
        from rowferry.operators import schema as S

        if self.last_commit() < 0:
            # Types are read in the source's dialect: a file target has Spark types of its own.
            return self.commit(S.empty_like(self.spark, S.apply_mappings(columns, mappings)))
        table = columns.first()["table"]
        current = S.describe({table: self.read()}, "spark", {table: self.keys})
        wanted = S.as_spark_types(S.apply_mappings(columns, mappings))
        diffs = S.schema_diff(wanted, current, "spark")
        if not allow_drop:
            diffs = diffs.where("action <> 'drop'")
        steps = diffs.orderBy("position").collect()
        base = self.last_commit()
        return self.commit(S.reshape(self.read(), steps), base=base) if steps else base

    def expire(self) -> list[int]:
        """Delete commits no bucket reads any more; run it when no reader holds an old view."""
        done = self._commits()
        if not done:
            return []
        used = {f for _, f in self._current()}
        log = self.spark.read.schema(LOG).parquet(*[f"{self.path}/commits/c={c}" for c in done])
        old = [(r["commit"], r["folder"]) for r in log.select("commit", "folder").distinct().collect() if r["folder"] not in used and r["commit"] != done[-1]]
        for c, folder in old:
            remove(self.spark, f"{self.path}/commits/c={c}")
            remove(self.spark, f"{self.path}/data/{folder}")
        return sorted(c for c, _ in old)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


class StateTable:
    """An append-only parquet table whose latest row per key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order

    def append(self, *rows: dict) -> None:
        data = [tuple(r.get(f.name) for f in self.schema.fields) for r in rows]
        small_frame(self.spark, data, self.schema).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def latest(self) -> DataFrame:
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        newest = self.all().groupBy(self.key).agg(F.max_by(F.struct(*rest), self.order).alias("r"))
        return newest.select(self.key, "r.*").select(self.schema.names)


def run_log(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/run_log", RUN_LOG_SCHEMA, "run_id", "seq")


def watermarks(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/watermarks", WATERMARK_SCHEMA, "job", "seq")


def copy_ledger(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/copies", COPY_SCHEMA, "job", "seq")


def as_log_row(result: JobResult, **extra) -> dict:
    return {
        "run_id": result.run_id,
        "job": result.job,
        "status": result.status,
        "rows_synced": result.rows,
        "error_msg": result.error,
        "file_path": result.file_path,
        **extra,
    }
