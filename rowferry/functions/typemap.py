"""Column-type translation between SQL dialects, as joins over a catalog frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The type each source type becomes in the target dialect.
TYPE_MAP = {
    ("mysql", "postgresql"): {
        "INT": "INTEGER",
        "INTEGER": "INTEGER",
        "TINYINT": "SMALLINT",
        "TINYINT(1)": "BOOLEAN",
        "SMALLINT": "SMALLINT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DECIMAL",
        "NUMERIC": "NUMERIC",
        "FLOAT": "REAL",
        "DOUBLE": "DOUBLE PRECISION",
        "REAL": "REAL",
        "VARCHAR": "VARCHAR",
        "CHAR": "CHAR",
        "TEXT": "TEXT",
        "CLOB": "TEXT",
        "BLOB": "BYTEA",
        "BOOLEAN": "BOOLEAN",
        "DATE": "DATE",
        "TIME": "TIME",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "JSON": "JSON",
    },
    ("mysql", "oracle"): {
        "INT": "NUMBER(10)",
        "INTEGER": "NUMBER(10)",
        "TINYINT": "NUMBER(3)",
        "TINYINT(1)": "NUMBER(1)",
        "SMALLINT": "NUMBER(5)",
        "BIGINT": "NUMBER(19)",
        "DECIMAL": "NUMBER",
        "NUMERIC": "NUMBER",
        "FLOAT": "FLOAT",
        "DOUBLE": "FLOAT",
        "REAL": "FLOAT",
        "VARCHAR": "VARCHAR2",
        "CHAR": "CHAR",
        "TEXT": "CLOB",
        "CLOB": "CLOB",
        "BLOB": "BLOB",
        "BOOLEAN": "NUMBER(1)",
        "DATE": "DATE",
        "TIME": "TIMESTAMP",
        "DATETIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "JSON": "CLOB",
    },
    ("postgresql", "mysql"): {
        "INTEGER": "INT",
        "INT": "INT",
        "SMALLINT": "SMALLINT",
        "BIGINT": "BIGINT",
        "DECIMAL": "DECIMAL",
        "NUMERIC": "DECIMAL",
        "REAL": "FLOAT",
        "DOUBLE PRECISION": "DOUBLE",
        "VARCHAR": "VARCHAR",
        "CHAR": "CHAR",
        "TEXT": "TEXT",
        "BYTEA": "BLOB",
        "BOOLEAN": "TINYINT(1)",
        "DATE": "DATE",
        "TIME": "TIME",
        "TIMESTAMP": "DATETIME",
        "JSON": "JSON",
        "SERIAL": "INT AUTO_INCREMENT",
    },
    ("postgresql", "oracle"): {
        "INTEGER": "NUMBER(10)",
        "INT": "NUMBER(10)",
        "SMALLINT": "NUMBER(5)",
        "BIGINT": "NUMBER(19)",
        "DECIMAL": "NUMBER",
        "NUMERIC": "NUMBER",
        "REAL": "FLOAT",
        "DOUBLE PRECISION": "FLOAT",
        "VARCHAR": "VARCHAR2",
        "CHAR": "CHAR",
        "TEXT": "CLOB",
        "BYTEA": "BLOB",
        "BOOLEAN": "NUMBER(1)",
        "DATE": "DATE",
        "TIME": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "JSON": "CLOB",
    },
    ("oracle", "mysql"): {
        "NUMBER": "DECIMAL",
        "NUMBER(1)": "TINYINT(1)",
        "VARCHAR2": "VARCHAR",
        "CHAR": "CHAR",
        "CLOB": "TEXT",
        "BLOB": "BLOB",
        "DATE": "DATETIME",
        "TIMESTAMP": "TIMESTAMP",
        "FLOAT": "DOUBLE",
        "INTEGER": "INT",
    },
    ("oracle", "postgresql"): {
        "NUMBER": "NUMERIC",
        "NUMBER(1)": "BOOLEAN",
        "VARCHAR2": "VARCHAR",
        "CHAR": "CHAR",
        "CLOB": "TEXT",
        "BLOB": "BYTEA",
        "DATE": "TIMESTAMP",
        "TIMESTAMP": "TIMESTAMP",
        "FLOAT": "DOUBLE PRECISION",
        "INTEGER": "INTEGER",
    },
}

# Short names PostgreSQL catalogs report for types the map knows by another name.
POSTGRES_ALIASES = {
    "INT2": "SMALLINT",
    "INT4": "INTEGER",
    "INT8": "BIGINT",
    "FLOAT4": "REAL",
    "FLOAT8": "DOUBLE PRECISION",
    "BOOL": "BOOLEAN",
    "BPCHAR": "CHAR",
    "TIMESTAMPTZ": "TIMESTAMP",
}

# Mapped types that keep the size of the source type.
SIZED_TYPES = ("VARCHAR", "VARCHAR2", "CHAR", "DECIMAL", "NUMERIC", "NUMBER")

# Fixed value: a type name and its size.
_SIZED = r"^([A-Z0-9 ]+?)(\([\d,]+\))$"


def type_map_frame(spark: SparkSession) -> DataFrame:
    """The map as rows ``(map_from, map_to, map_type, mapped)``; about a hundred, never grows."""
    rows = []
    for (src, dst), pairs in TYPE_MAP.items():
        known = dict(pairs)
        if src == "postgresql":
            known.update({short: pairs[full] for short, full in POSTGRES_ALIASES.items()})
        rows += [f"('{src}', '{dst}', '{base}', '{mapped}')" for base, mapped in known.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(map_from, map_to, map_type, mapped)")


def map_types(columns: DataFrame, to_dialect: str, type_col: str = "raw_type", out: str = "mapped_type") -> DataFrame:
    """Add ``out``: ``type_col`` of each row's ``dialect`` translated to ``to_dialect``.

    The whole text is looked up first (``TINYINT(1)``), then the name without its
    size. A size is kept only on types that carry one; unknown types pass through
    in upper case. Both lookups hash-join the fixed map, so a catalog of any
    size needs no shuffle.
    """
    table = type_map_frame(columns.sparkSession).where(F.col("map_to") == to_dialect.lower())
    whole = table.select(F.col("map_from").alias("w_from"), F.col("map_type").alias("w_type"), F.col("mapped").alias("w_mapped"))
    base = table.select(F.col("map_from").alias("b_from"), F.col("map_type").alias("b_type"), F.col("mapped").alias("b_mapped"))
    upper = F.upper(F.trim(F.col(type_col)))
    probe = (
        columns.withColumn("m_from", F.lower("dialect"))
        .withColumn("m_type", upper)
        .withColumn("m_base", F.trim(F.regexp_extract("m_type", _SIZED, 1)))
        .withColumn("m_size", F.regexp_extract("m_type", _SIZED, 2))
    )
    sized = F.when(F.col("b_mapped").isin(*SIZED_TYPES), F.concat("b_mapped", "m_size")).otherwise(F.col("b_mapped"))
    return (
        probe.join(F.broadcast(whole), (F.col("m_from") == F.col("w_from")) & (F.col("m_type") == F.col("w_type")), "left")
        .join(F.broadcast(base), (F.col("m_from") == F.col("b_from")) & (F.col("m_base") == F.col("b_type")), "left")
        .withColumn(out, F.coalesce("w_mapped", sized, "m_type"))
        .select(*columns.columns, out)
    )


def spark_type(raw: str, dialect: str = "") -> str:
    """The Spark DDL type that holds values of a raw type (sizes of text are dropped)."""
    text = raw.strip().upper()
    if dialect == "spark":
        return text.lower()
    base, _, size = text.partition("(")
    base, size = base.strip(), size.rstrip(")").replace(" ", "")
    if text in ("TINYINT(1)", "NUMBER(1)") or base in ("BOOLEAN", "BOOL"):
        return "boolean"
    if base in ("TINYINT", "SMALLINT", "INT2"):
        return "smallint"
    if base in ("INT", "INTEGER", "SERIAL", "INT4"):
        return "int"
    if base in ("BIGINT", "INT8") or text == "NUMBER(19)":
        return "bigint"
    if base in ("DECIMAL", "NUMERIC", "NUMBER"):
        return f"decimal({size})" if size else "decimal(38,18)"
    if base in ("REAL", "FLOAT4"):
        return "float"
    if base == "FLOAT":
        return "double" if dialect == "oracle" else "float"
    if base in ("DOUBLE", "DOUBLE PRECISION", "FLOAT8"):
        return "double"
    if base in ("BLOB", "BYTEA"):
        return "binary"
    if base == "DATE":
        return "timestamp_ntz" if dialect == "oracle" else "date"
    if base in ("DATETIME", "TIMESTAMP", "TIMESTAMPTZ"):
        return "timestamp_ntz"
    return "string"
