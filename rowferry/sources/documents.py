"""Document collections kept as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowferry.model import COLUMNS_SCHEMA
from rowferry.operators.filters import document_predicate
from rowferry.operators.mapping import column

def flat_columns(schema: T.StructType) -> list[tuple[str, Column]]:
    """(dotted name, column) of every leaf; arrays are leaves."""
    out: list[tuple[str, Column]] = []

    def walk(struct: T.StructType, names: tuple[str, ...]):
        for f in struct.fields:
            path = (*names, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, path)
            else:
                ref = ".".join("`" + p.replace("`", "``") + "`" for p in path)
                out.append((".".join(path), F.col(ref)))

    walk(schema, ())
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested documents become ``parent.child`` columns; one projection, whatever the depth."""
    return df.select([c.alias(name) for name, c in flat_columns(df.schema)])


def read_documents(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    filter_json: str = "",
    schema: T.StructType | None = None,
) -> DataFrame:
    """A collection: filtered, projected and flattened. ``_id`` comes only when asked for or all columns are.

    Give a schema for large collections: inferring one reads them once more.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    docs = reader.json(path)
    flat = flatten(docs.where(document_predicate(docs.schema, filter_json)))
    if not columns:
        return flat
    wanted = [c for c in flat.columns if any(c == w or c.startswith(w + ".") for w in columns)]
    return flat.select([column(c) for c in wanted])


def document_schema(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Catalog rows of every field that any document has, flattened, by name.

    Types are int, double, bool and string, the last also where documents
    disagree or hold arrays; ``_id`` is the non-null key. Spark infers the
    structure over all documents; unreadable ones are passed over.
    """
    leaves = [(n, t) for n, t in _leaf_types(spark.read.json(path).schema, "") if n != "_corrupt_record"]
    rows = [(table, i, n, _type_name(t), n != "_id", None, n == "_id", "mongodb") for i, (n, t) in enumerate(leaves, 1)]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def _leaf_types(schema: T.StructType, prefix: str):
    for f in schema.fields:
        name = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            yield from _leaf_types(f.dataType, name)
        else:
            yield name, f.dataType


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    return "double" if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else "string"


def write_documents(df: DataFrame, path: str, mode: str = "append") -> str:
    """JSON lines; dotted column names stay literal dotted field names."""
    df.write.mode(mode).json(path)
    return path
