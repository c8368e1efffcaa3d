"""Relational endpoints through Spark's JDBC source.

Rows are read and written by executors. The driver only sends catalog
statements, DDL and the one statement that merges a staged table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowferry.functions.names import quote_name
from rowferry.model import COLUMNS_SCHEMA, Endpoint
from rowferry.operators.merge import keep_last
from rowferry.operators.shards import MAX_SOURCE_SHARDS, KeyRange, check_shards, edge_predicates, is_integer_key

# Fixed value: rows per fetch and per insert batch.
BATCH_ROWS = 1000

DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "doris": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
}


def jdbc_url(e: Endpoint) -> str:
    """The URL of an endpoint; an Oracle ``SID=`` in ``extra`` replaces the service name."""
    if e.url:
        return e.url
    where = f"{e.host}:{e.port}"
    if e.kind in ("mysql", "doris"):
        return f"jdbc:mysql://{where}/{e.database}" + (f"?{e.extra}" if e.extra else "")
    if e.kind in ("postgresql", "clickhouse"):
        return f"jdbc:{e.kind}://{where}/{e.database}" + (f"?{e.extra}" if e.extra else "")
    if e.kind == "oracle":
        options = dict(p.split("=", 1) for p in e.extra.split("&") if "=" in p)
        sid = next((v for k, v in options.items() if k.lower() == "sid"), "")
        return f"jdbc:oracle:thin:@{where}:{sid}" if sid else f"jdbc:oracle:thin:@//{where}/{e.database}"
    raise ValueError(f"unknown endpoint kind: {e.kind}")


def _options(e: Endpoint) -> dict[str, str]:
    if e.kind not in DRIVERS:
        raise ValueError(f"unknown endpoint kind: {e.kind}")
    out = {"url": jdbc_url(e), "driver": e.driver or DRIVERS[e.kind]}
    if e.user:
        out |= {"user": e.user, "password": e.password}
    return out


def _table(e: Endpoint, table: str) -> str:
    """``schema.table`` quoted part by part for the endpoint's dialect."""
    return ".".join(quote_name(p, e.kind) for p in table.split("."))


def read_table(spark: SparkSession, e: Endpoint, table: str) -> DataFrame:
    """One-connection scan; filters, columns and limits push down to the source."""
    return spark.read.format("jdbc").options(**_options(e)).option("dbtable", _table(e, table)).option("fetchsize", BATCH_ROWS).load()


def read_query(spark: SparkSession, e: Endpoint, sql: str) -> DataFrame:
    """The result of a query the source itself runs."""
    text = sql.strip().rstrip(";").strip()
    return spark.read.format("jdbc").options(**_options(e)).option("query", text).option("fetchsize", BATCH_ROWS).load()


def read_sharded(spark: SparkSession, e: Endpoint, table: str, key: str, shards: int, where: str = "", max_shards: int = MAX_SOURCE_SHARDS) -> DataFrame:
    """Parallel scan of equal key ranges, one connection each.

    The bounds come from one MIN/MAX the source computes under the filter. More
    shards than ``max_shards``, the connections one database is asked to bear,
    are an error. A key that is no integer has no ranges to cut and is read over
    one connection.
    """
    n = check_shards(shards, max_shards)
    probe = read_table(spark, e, table)
    if key not in probe.columns or not is_integer_key(probe, key):
        return probe.where(where) if where else probe
    name = quote_name(key, e.kind)
    text = f"SELECT COALESCE(MIN({name}), 0) AS LOW_KEY, COALESCE(MAX({name}), 0) AS HIGH_KEY FROM {_table(e, table)}"
    low, high = read_query(spark, e, text + (f" WHERE {where}" if where else "")).first()
    plan = KeyRange(int(low), int(high), n)
    # Predicates in the source's quoting; the first also holds null keys.
    predicates = [p.replace("`" + key.replace("`", "``") + "`", name) for p in plan.predicates(key)]
    predicates = ["1=1" if p == "true" else p for p in predicates]
    if where:
        predicates = [f"({where}) AND {p}" for p in predicates]
    options = _options(e)
    return spark.read.jdbc(
        options.pop("url"), _table(e, table), predicates=predicates, properties={**options, "fetchsize": str(BATCH_ROWS)}
    )


def edges_query(e: Endpoint, table: str, key: str, shards: int, where: str = "") -> str:
    """The query by which a source itself cuts a table into ranges of like numbers of rows: where each but the first begins."""
    name = quote_name(key, e.kind)
    kept = f"{name} IS NOT NULL" + (f" AND ({where})" if where else "")
    tiles = f"SELECT {name} AS EDGE, NTILE({shards}) OVER (ORDER BY {name}) AS TILE FROM {_table(e, table)} WHERE {kept}"
    return f"SELECT TILE, MIN(EDGE) AS EDGE FROM ({tiles}) T WHERE TILE > 1 GROUP BY TILE"


def edge_literal(value, kind: T.DataType) -> str:
    """A range's edge as the source's SQL reads it."""
    if isinstance(kind, T.NumericType):
        return str(value)
    if isinstance(kind, T.DateType):
        return f"DATE '{value}'"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"TIMESTAMP '{value}'"
    return "'" + str(value).replace("'", "''") + "'"


def read_balanced(spark: SparkSession, e: Endpoint, table: str, key: str, shards: int, where: str = "", max_shards: int = MAX_SOURCE_SHARDS) -> DataFrame:
    """Parallel scan of key ranges with like numbers of rows, one connection each; for numbers, texts, dates and timestamps.

    The source cuts the ranges, in its own order of the key: one query that
    returns an edge for each range.
    """
    n = check_shards(shards, max_shards)
    found = read_query(spark, e, edges_query(e, table, key, n, where))
    kind = found.schema[1].dataType
    instant = isinstance(kind, T.TimestampType)
    # In the source's order, which need not be Spark's.
    rows = found.select(found[0].alias("tile"), (found[1].cast("timestamp_ntz") if instant else found[1]).alias("edge")).orderBy("tile").collect()
    edges = tuple(dict.fromkeys(edge_literal(r["edge"], kind) for r in rows))
    predicates = ["1=1" if p == "true" else p for p in edge_predicates(quote_name(key, e.kind), edges)]
    if where:
        predicates = [f"({where}) AND ({p})" for p in predicates]
    options = _options(e)
    return spark.read.jdbc(options.pop("url"), _table(e, table), predicates=predicates, properties={**options, "fetchsize": str(BATCH_ROWS)})


def count_rows(spark: SparkSession, e: Endpoint, table: str) -> int:
    """Rows of a table, counted by the source."""
    return int(read_query(spark, e, f"SELECT COUNT(*) AS N FROM {_table(e, table)}").first()[0])


def append_rows(df: DataFrame, e: Endpoint, table: str, connections: int = MAX_SOURCE_SHARDS) -> None:
    """Append; columns meet by name, each partition inserts in batches over its own connection.

    ``connections`` caps how many write at once, as the database, not the
    cluster, is what gives out first.
    """
    writer = df.write.format("jdbc").options(**_options(e)).option("dbtable", _table(e, table))
    writer.option("batchsize", BATCH_ROWS).option("numPartitions", connections).mode("append").save()


def create_like(df: DataFrame, e: Endpoint, table: str) -> None:
    """Make an empty table of a DataFrame's structure unless it is there; Spark's dialect picks the types."""
    df.limit(0).write.format("jdbc").options(**_options(e)).option("dbtable", _table(e, table)).mode("ignore").save()


class _Connection:
    """A driver-side JDBC connection for statements, never for rows."""

    def __init__(self, spark: SparkSession, e: Endpoint):
        jvm = spark._jvm
        options = _options(e)
        props = jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in options:
                props.setProperty(k, options[k])
        # Spark's registry also finds drivers that came with --jars.
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
        self.raw = jvm.java.sql.DriverManager.getConnection(options["url"], props)

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.raw.close()

    def execute(self, *statements: str) -> None:
        st = self.raw.createStatement()
        try:
            for s in statements:
                st.execute(s)
        finally:
            st.close()


def execute(spark: SparkSession, e: Endpoint, *statements: str) -> None:
    """Run statements on the driver (DDL, merge); an error stops at the failing one."""
    with _Connection(spark, e) as c:
        c.execute(*statements)


def list_tables(spark: SparkSession, e: Endpoint) -> DataFrame:
    """Table names of the endpoint, sorted; from the JDBC catalog, so no rows are read."""
    with _Connection(spark, e) as c:
        rows = _metadata(c.raw.getMetaData().getTables(None, _schema_of(e, c), "%", None), ["TABLE_NAME", "TABLE_TYPE"])
    names = sorted((r[0],) for r in rows if r[1] == "TABLE")
    return spark.createDataFrame(names, "table string")


def _schema_of(e: Endpoint, c: _Connection):
    if e.kind == "oracle":
        return e.user.upper()
    return c.raw.getSchema() if e.kind == "postgresql" else None


def _metadata(cursor, names: Sequence[str]) -> list[tuple]:
    rows = []
    try:
        while cursor.next():
            rows.append(tuple(cursor.getString(n) for n in names))
    finally:
        cursor.close()
    return rows


def describe_tables(spark: SparkSession, e: Endpoint, tables: Sequence[str]) -> DataFrame:
    """Catalog rows of tables: raw type with its size, nullability, default and key flag, in column order.

    Metadata only: a few rows per table pass through the driver.
    """
    out = []
    with _Connection(spark, e) as c:
        meta, schema = c.raw.getMetaData(), _schema_of(e, c)
        for table in tables:
            keys = {k for (k,) in _metadata(meta.getPrimaryKeys(None, schema, table), ["COLUMN_NAME"])}
            fields = ["COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE", "COLUMN_DEF", "ORDINAL_POSITION"]
            for name, kind, size, scale, nullable, default, ordinal in _metadata(meta.getColumns(None, schema, table, None), fields):
                out.append(
                    (table, int(ordinal), name, _sized(kind, size, scale), nullable == "YES", default, name in keys, e.kind)
                )
    return spark.createDataFrame(out, COLUMNS_SCHEMA)


def _sized(kind: str, size: str | None, scale: str | None) -> str:
    base = kind.upper()
    if base in ("VARCHAR", "VARCHAR2", "CHAR", "BPCHAR") and size:
        return f"{base}({size})"
    if base in ("DECIMAL", "NUMERIC", "NUMBER") and size and int(size) > 0:
        return f"{base}({size},{scale})" if scale and int(scale) else f"{base}({size})"
    return base


def merge_statement(
    dialect: str, table: str, stage: str, columns: Sequence[str], keys: Sequence[str], distinct: bool = True
) -> str:
    """One statement that upserts a staged table into the target, in the target's SQL.

    Keys are never updated; a table of nothing but keys only gains rows.
    ClickHouse has no upsert, so there it is a plain insert. A task that is run
    again after its rows were committed stages them twice, so they are read
    ``distinct``; turn that off for large-object columns a store cannot compare.
    """
    q = [quote_name(c, dialect) for c in columns]
    kq = [quote_name(k, dialect) for k in keys]
    free = [quote_name(c, dialect) for c in columns if c not in keys]
    cols = ", ".join(q)
    rows = f"SELECT {'DISTINCT ' if distinct else ''}{cols} FROM {stage}"
    insert = f"INSERT INTO {table} ({cols}) {rows}"
    if dialect == "clickhouse":
        return insert
    if dialect in ("mysql", "doris"):
        sets = ", ".join(f"{c} = VALUES({c})" for c in free) or f"{kq[0]} = {table}.{kq[0]}"
        return f"{insert} ON DUPLICATE KEY UPDATE {sets}"
    if dialect == "postgresql":
        action = "UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in free) if free else "NOTHING"
        return f"{insert} ON CONFLICT ({', '.join(kq)}) DO {action}"
    match = " AND ".join(f"t.{k} = s.{k}" for k in kq)
    update = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{c} = s.{c}" for c in free) + " " if free else ""
    values = ", ".join(f"s.{c}" for c in q)
    return f"MERGE INTO {table} t USING ({rows}) s ON ({match}) {update}WHEN NOT MATCHED THEN INSERT ({cols}) VALUES ({values})"


def upsert_rows(
    df: DataFrame, e: Endpoint, table: str, keys: Sequence[str], order_by: Sequence[str], distinct: bool = True
) -> None:
    """Upsert: executors fill a staging table in the target database, one statement merges it.

    Repeated input keys are settled before staging, so the merge meets each key
    once. The staging table is dropped whatever happens.
    """
    if not keys:
        raise ValueError("upsert needs the key columns of the target")
    spark = df.sparkSession
    stage_name = f"{table.split('.')[-1]}_stage_{uuid.uuid4().hex[:12]}"
    stage, target = _table(e, stage_name), _table(e, table)
    fresh = keep_last(df, keys, order_by)
    cols = ", ".join(quote_name(c, e.kind) for c in fresh.columns)
    execute(spark, e, f"CREATE TABLE {stage} AS SELECT {cols} FROM {target} WHERE 1=0")
    try:
        append_rows(fresh, e, stage_name)
        execute(spark, e, merge_statement(e.kind, target, stage, fresh.columns, keys, distinct))
    finally:
        execute(spark, e, f"DROP TABLE {stage}")


def sync_structure(
    spark: SparkSession,
    source_columns: DataFrame,
    e: Endpoint,
    table: str,
    mappings: DataFrame | None = None,
    allow_drop: bool = False,
) -> list[str]:
    """Bring a target table to the source's structure: create it, else alter it; returns what was run.

    Extra target columns are dropped only with ``allow_drop``.
    """
    from rowferry.operators import schema as S

    source = source_columns.withColumn("table", F.lit(table))
    if mappings is not None:
        mappings = mappings.withColumn("table", F.lit(table))
    current = describe_tables(spark, e, [table])
    if current.isEmpty():
        statements = [r["ddl"] for r in S.create_table_ddl(source, e.kind, mappings).collect()]
    else:
        diffs = S.schema_diff(source, current, e.kind, mappings)
        if not allow_drop:
            diffs = diffs.where("action <> 'drop'")
        statements = [r["ddl"] for r in S.alter_ddl(diffs, e.kind).orderBy("position").collect()]
    execute(spark, e, *statements)
    return statements


