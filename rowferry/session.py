"""Session helpers: where scratch tables live and how a local session is built."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What one broadcast may weigh as compressed parquet; several times that in memory.
BROADCAST_BYTES = 32 * 1024 * 1024


def local_session(cpus: int | str = 8, app: str = "rowferry") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster supplies its own."""
    shuffle = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may name none; it then gets a local folder,
    the same one for all its calls. On a cluster that is an error, as executors
    and driver share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="rowferry-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/rowferry/{label}-{uuid.uuid4().hex}"


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few driver-side rows (log entries, commit marks) as a one-task frame."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in kind.fields]
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(kind)), kind).coalesce(1)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file unless it is there, in one step; whether this call made it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
    except Exception as error:  # noqa: BLE001 - the file systems name this differently
        if "AlreadyExists" in str(error) or fs.exists(p):
            return False
        raise
    return True


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths a glob pattern finds."""
    fs, p = _fs(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(p) or []]


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def move_in(spark: SparkSession, source: str, folder: str, prefix: str) -> None:
    """Move the data files of one folder into another, each under a name of its own; files that are there already stay.

    Names depend on ``prefix`` and the files' order alone, so a move that broke off is finished by another call.
    """
    fs, to = _fs(spark, folder)
    fs.mkdirs(to)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in [n for n in children(spark, source) if n.startswith("part-")]:
        target = path(f"{folder}/{prefix}-{name}")
        if not fs.exists(target) and not fs.rename(path(f"{source}/{name}"), target):
            raise OSError(f"cannot move {source}/{name} to {folder}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Staged:
    """A frame written once to the shared folder, so reading it again costs no recomputation.

    It survives lost executors, and its size is a fact: ``small`` says whether
    it may be broadcast. Used as a context manager it is removed at the end.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.small = size_of(self.spark, self.path) <= BROADCAST_BYTES

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *exc) -> None:
        remove(self.spark, self.path)
