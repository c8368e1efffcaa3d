"""CSV and parquet tables, and listings of the tables in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowferry.operators.mapping import column
from rowferry.sources.records import read_records


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; every column is text and an empty cell stays an empty text.

    Quotes double inside quotes and may hold newlines; a ragged record fails the
    read, also of a query that needs few columns. Files are read in splits of any
    size, whether or not a record spans lines: see ``records``.
    """
    header = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return read_records(spark, path, header.columns) if header.columns else header


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = (), mode: str = "append") -> str:
    """Append as text: a folder of part files with one header each; nulls are empty cells."""
    order = list(columns) or sorted(df.columns)
    text = df.select([column(c).cast("string").alias(c) for c in order])
    text.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return path


def list_tables(spark: SparkSession, folder: str, suffix: str = "csv") -> DataFrame:
    """Tables of a folder by file base name, sorted; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    base = F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1)
    return files.select(base.alias("table")).distinct().orderBy("table")
