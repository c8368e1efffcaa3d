"""Plain records that describe endpoints, mappings and jobs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldMapping:
    """Copy ``source`` to ``target`` (blank keeps the name) unless disabled."""

    source: str
    target: str = ""
    enabled: bool = True

    @property
    def name(self) -> str:
        return self.target or self.source


@dataclass(frozen=True)
class Endpoint:
    """Where tables live. ``kind`` picks the reader and the SQL dialect.

    Relational kinds use host, port, user, password, database and extra (or an
    explicit ``url``); file and document kinds use ``path``.
    """

    kind: str
    path: str = ""
    host: str = ""
    port: int = 0
    user: str = ""
    password: str = ""
    database: str = ""
    extra: str = ""
    url: str = ""
    driver: str = ""
    name: str = ""

    @classmethod
    def from_json(cls, text: str) -> Endpoint:
        """An endpoint from its stored JSON form; unknown fields are left out, a kind is required."""
        raw = json.loads(text)
        # The field names of the stored form.
        names = {
            "db_type": "kind",
            "host": "host",
            "port": "port",
            "username": "user",
            "password": "password",
            "database_name": "database",
            "extra_params": "extra",
            "name": "name",
        }
        known = {names[k]: v for k, v in raw.items() if k in names}
        if not known.get("kind"):
            raise ValueError("the endpoint names no db_type")
        known["kind"] = known["kind"].lower()
        # Files are addressed by what a database calls its host.
        if known["kind"] in ("csv", "excel", "parquet", "mongodb"):
            known["path"] = known.get("host", "")
        return cls(**known)


@dataclass(frozen=True)
class Watermark:
    """High-water column of an incremental job; ``kind`` is ``id`` or ``timestamp``.

    ``overlap``, in ids or seconds, is how far below the last mark each run
    looks again, for rows that were committed late or tie with the mark.
    """

    column: str
    kind: str
    overlap: int = 0

    def __post_init__(self):
        if self.kind not in ("id", "timestamp"):
            raise ValueError(f"unknown watermark kind: {self.kind}")


@dataclass(frozen=True)
class ParamOption:
    value: str
    label: str = ""


@dataclass(frozen=True)
class ParamDef:
    """One named query parameter. ``input_type``: text, number, date, datetime, select."""

    name: str
    input_type: str = "text"
    required: bool = False
    default: str = ""
    options: Sequence[ParamOption] = ()
    label: str = ""
    order: int = 0


@dataclass(frozen=True)
class JobSpec:
    """One movement job.

    ``kind``: structure, data, both or sql_import. ``write``: append, skip,
    upsert or replace. ``order_by`` names the columns that decide which of
    several input rows with one key is the last. With ``balanced`` a sharded
    read cuts ranges with like numbers of rows, for keys of any type. With
    ``chunks`` a data job copies range by range of ``chunk_key`` (the first key
    by default), and a run after a failure goes on where the last one stopped.
    """

    name: str
    source: Endpoint
    target: Endpoint
    kind: str = "data"
    source_table: str = ""
    target_table: str = ""
    mappings: Sequence[FieldMapping] = ()
    filter: str = ""
    write: str = "append"
    keys: Sequence[str] = ()
    order_by: Sequence[str] = ()
    watermark: Watermark | None = None
    sql: str = ""
    params: Sequence[ParamDef] = ()
    shards: int = 1
    balanced: bool = False
    chunks: int = 0
    chunk_key: str = ""
    quality: bool = True
    allow_drop: bool = False
    source_tables: Sequence[str] = ()
    # Connections a sharded read may open, tasks that write to a database at once, and buckets of a new keyed table.
    max_shards: int = 8
    connections: int = 8
    buckets: int | None = None


@dataclass
class JobResult:
    run_id: str
    job: str
    status: str
    rows: int = 0
    error: str = ""
    high_water: str = ""
    file_path: str = ""
    quality: dict = field(default_factory=dict)


RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("job", T.StringType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("rows_synced", T.LongType()),
        T.StructField("error_msg", T.StringType()),
        T.StructField("source_rows", T.LongType()),
        T.StructField("target_rows", T.LongType()),
        T.StructField("sample_total", T.LongType()),
        T.StructField("sample_matched", T.LongType()),
        T.StructField("quality_status", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("triggered_by", T.StringType()),
    ]
)

# One row when a copy in chunks is planned, one when it is whole, and one for each chunk that is in the target.
COPY_SCHEMA = T.StructType(
    [
        T.StructField("job", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("copy", T.LongType(), False),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("state", T.StringType(), False),
        T.StructField("rows", T.LongType()),
        T.StructField("low_mark", T.StringType()),
        T.StructField("high_mark", T.StringType()),
        T.StructField("edges", T.StringType()),
    ]
)

WATERMARK_SCHEMA = T.StructType(
    [
        T.StructField("job", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.StringType()),
    ]
)

COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("raw_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("default_val", T.StringType()),
        T.StructField("is_primary", T.BooleanType()),
        T.StructField("dialect", T.StringType()),
    ]
)
