"""Table structure as data: column catalogs, their differences and the DDL that follows.

A catalog is a frame with one row per column (``COLUMNS_SCHEMA``), so the
structures of thousands of tables are compared and translated in one job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rowferry.functions.names import quote_column
from rowferry.functions.typemap import map_types, spark_type
from rowferry.model import COLUMNS_SCHEMA, FieldMapping
from rowferry.operators.mapping import column


def describe(frames: Mapping[str, DataFrame], dialect: str = "spark", keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Catalog rows of DataFrames: metadata only, nothing is read.

    A field's ``raw_type`` and ``primary_key`` metadata win over its Spark type.
    """
    keys = keys or {}
    rows = [
        (
            table,
            i,
            f.name,
            f.metadata.get("raw_type") or f.dataType.simpleString().upper(),
            f.nullable,
            f.metadata.get("default"),
            bool(f.metadata.get("primary_key")) or f.name in keys.get(table, ()),
            dialect,
        )
        for table, df in frames.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def mark_primary(columns: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Set ``is_primary`` from a catalog of key columns ``(table, name)``.

    Key rows are made distinct first: a column in two key constraints must not
    repeat the column.
    """
    keys = key_columns.select("table", "name").distinct().withColumn("_key", F.lit(True))
    return columns.join(keys, ["table", "name"], "left").select(
        *[F.col("_key").isNotNull().alias(c) if c == "is_primary" else F.col(c) for c in columns.columns]
    )


def mapping_frame(spark: SparkSession, mappings: Mapping[str, Iterable[FieldMapping]]) -> DataFrame:
    """Per-table field mappings as rows ``(table, name, new_name, enabled)``."""
    rows = [(t, m.source, m.name, m.enabled) for t, ms in mappings.items() for m in ms]
    return spark.createDataFrame(rows, "table string, name string, new_name string, enabled boolean")


def apply_mappings(columns: DataFrame, mappings: DataFrame | None) -> DataFrame:
    """Rename mapped columns, drop disabled ones, keep the rest (the structure-sync rule)."""
    if mappings is None:
        return columns
    return (
        columns.join(mappings, ["table", "name"], "left")
        .where(F.coalesce("enabled", F.lit(True)))
        .select(*[F.coalesce("new_name", "name").alias(c) if c == "name" else F.col(c) for c in columns.columns])
    )


def to_dialect(columns: DataFrame, dialect: str) -> DataFrame:
    """The catalog as the target dialect spells it: ``raw_type`` mapped, ``dialect`` replaced."""
    mapped = map_types(columns, dialect)
    return mapped.select(
        *[
            F.col("mapped_type").alias(c) if c == "raw_type" else F.lit(dialect).alias(c) if c == "dialect" else F.col(c)
            for c in columns.columns
        ]
    )


def create_table_ddl(
    columns: DataFrame,
    dialect: str,
    mappings: DataFrame | None = None,
    table_names: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(table, ddl)``: one CREATE TABLE per table of the catalog.

    A group holds one table's columns, which every store caps at a few thousand.
    """
    target = to_dialect(apply_mappings(columns, mappings), dialect)
    name = quote_column(F.col("name"), dialect)
    line = F.concat(
        name,
        F.lit(" "),
        F.col("raw_type"),
        F.when(~F.col("nullable") & ~F.col("is_primary"), " NOT NULL").otherwise(""),
        F.when(F.coalesce("default_val", F.lit("")) != "", F.concat(F.lit(" DEFAULT "), "default_val")).otherwise(""),
    )
    by_table = (
        target.select("table", "ordinal", line.alias("line"), F.when(F.col("is_primary"), name).alias("key"))
        .groupBy("table")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "line", "key"))).alias("cols"))
    )
    keys = F.filter(F.transform("cols", lambda c: c["key"]), lambda k: k.isNotNull())
    body = F.concat_ws(
        ",\n  ",
        F.transform("cols", lambda c: c["line"]),
        F.when(F.size(keys) > 0, F.concat(F.lit("PRIMARY KEY ("), F.concat_ws(", ", keys), F.lit(")"))),
    )
    shown = F.col("table")
    if table_names:
        renamed = F.lit(None).cast("string")
        for old, new in table_names.items():
            renamed = F.when(F.col("table") == old, F.lit(new)).otherwise(renamed)
        shown = F.coalesce(renamed, shown)
    return by_table.select(
        shown.alias("table"),
        F.concat(F.lit("CREATE TABLE "), quote_column(shown, dialect), F.lit(" (\n  "), body, F.lit("\n)")).alias("ddl"),
    )


def schema_diff(source: DataFrame, target: DataFrame, dialect: str, mappings: DataFrame | None = None) -> DataFrame:
    """What turns each target table into its source: add, modify and drop rows.

    Source types and names are brought to the target dialect first, then names
    meet without regard to case and types likewise. ``position`` orders the
    steps: source columns first, extra target columns after them.
    """
    s = to_dialect(apply_mappings(source, mappings), dialect)
    s = s.select("table", F.lower("name").alias("key"), F.struct("ordinal", "name", "raw_type", "nullable", "default_val").alias("s"))
    t = target.select("table", F.lower("name").alias("key"), F.struct("ordinal", "name", "raw_type", "nullable", "default_val").alias("t"))
    # Spellings of one name that differ in case alone: the last one counts.
    t = t.groupBy("table", "key").agg(F.max("t").alias("t"))
    joined = s.join(t, ["table", "key"], "full_outer")
    action = (
        F.when(F.col("t").isNull(), "add")
        .when(F.col("s").isNull(), "drop")
        .when(F.upper(F.trim("s.raw_type")) != F.upper(F.trim("t.raw_type")), "modify")
    )
    side = F.when(F.col("s").isNull(), F.col("t")).otherwise(F.col("s"))
    # A modify addresses the column by the target's own spelling.
    name = F.coalesce("t.name", "s.name")
    return joined.withColumn("action", action).where(F.col("action").isNotNull()).select(
        "table",
        "action",
        name.alias("name"),
        side["raw_type"].alias("raw_type"),
        side["nullable"].alias("nullable"),
        side["default_val"].alias("default_val"),
        (F.when(F.col("s").isNull(), F.lit(1_000_000)).otherwise(F.lit(0)) + side["ordinal"]).alias("position"),
    )


def alter_ddl(diffs: DataFrame, dialect: str) -> DataFrame:
    """``(table, position, ddl)``: one ALTER TABLE per difference.

    Types in ``diffs`` are already the target's. Dialects without a known
    MODIFY form get no statement for it, as no wording would run there.
    """
    dialect = dialect.lower()
    head = F.concat(F.lit("ALTER TABLE "), quote_column(F.col("table"), dialect))
    name = quote_column(F.col("name"), dialect)
    kind = F.col("raw_type")
    null = F.when(F.col("nullable"), "").otherwise(" NOT NULL")
    if dialect == "oracle":
        add = F.concat(head, F.lit(" ADD ("), name, F.lit(" "), kind, null, F.lit(")"))
        drop = F.concat(head, F.lit(" DROP ("), name, F.lit(")"))
    else:
        add = F.concat(head, F.lit(" ADD COLUMN "), name, F.lit(" "), kind, null)
        drop = F.concat(head, F.lit(" DROP COLUMN "), name)
    modify = {
        "mysql": F.concat(head, F.lit(" MODIFY COLUMN "), name, F.lit(" "), kind),
        "doris": F.concat(head, F.lit(" MODIFY COLUMN "), name, F.lit(" "), kind),
        "postgresql": F.concat(head, F.lit(" ALTER COLUMN "), name, F.lit(" TYPE "), kind),
        "oracle": F.concat(head, F.lit(" MODIFY ("), name, F.lit(" "), kind, F.lit(")")),
    }.get(dialect, F.lit(None).cast("string"))
    text = F.when(F.col("action") == "add", add).when(F.col("action") == "modify", modify).otherwise(drop)
    return diffs.select("table", "position", text.alias("ddl")).where(F.col("ddl").isNotNull())


def as_spark_types(columns: DataFrame) -> DataFrame:
    """The catalog with Spark types in place of raw ones; one table's rows."""
    rows = columns.collect()
    typed = [{**r.asDict(), "raw_type": spark_type(r["raw_type"], r["dialect"]).upper(), "dialect": "spark"} for r in rows]
    return columns.sparkSession.createDataFrame([tuple(t[c] for c in COLUMNS_SCHEMA.names) for t in typed], COLUMNS_SCHEMA)


def reshape(df: DataFrame, steps: Iterable[Row]) -> DataFrame:
    """A file-backed table after its structure differences (in Spark types): added, cast and dropped columns.

    ``steps`` are the ordered difference rows of this one table; the table
    itself is only given a new select list.
    """
    out = df
    for step in steps:
        if step["action"] == "add":
            out = out.withColumn(step["name"], F.lit(None).cast(step["raw_type"].lower()))
        elif step["action"] == "modify":
            out = out.withColumn(step["name"], column(step["name"]).cast(step["raw_type"].lower()))
        else:
            out = out.drop(step["name"])
    return out


def empty_like(spark: SparkSession, columns: DataFrame) -> DataFrame:
    """An empty table of a catalog's structure (one table's rows)."""
    rows = columns.orderBy("ordinal").collect()
    ddl = ", ".join(f"`{r['name']}` {spark_type(r['raw_type'], r['dialect'])}" for r in rows)
    return spark.createDataFrame([], ddl)
