"""Column mapping between a source and a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rowferry.model import FieldMapping


def column(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_pairs(mappings: Sequence[FieldMapping], columns: Sequence[str]) -> list[tuple[str, str]]:
    """(source, target) names of a copy: enabled mappings in order, or every column unmapped."""
    enabled = [(m.source, m.name) for m in mappings if m.enabled]
    return enabled or [(c, c) for c in columns]


def map_columns(df: DataFrame, mappings: Sequence[FieldMapping] = ()) -> DataFrame:
    """Keep and rename the enabled columns; nothing enabled keeps all of them."""
    return df.select([column(s).alias(t) for s, t in column_pairs(mappings, df.columns)])


def rename_feed(names: Sequence[str], mappings: Sequence[FieldMapping] = ()) -> dict[str, str]:
    """Source to target names of a change feed: unmapped columns keep their own name, disabled ones drop."""
    known = {m.source: m for m in mappings}
    return {n: known[n].name if n in known else n for n in names if n not in known or known[n].enabled}


def auto_map(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Columns present on both sides of the catalog, matched without regard to case.

    Works over many tables at once; ``target_field`` is the target's own spelling.
    """
    target = target_columns.select(
        "table", F.lower("name").alias("key"), F.col("name").alias("target_field")
    )
    return (
        source_columns.select("table", "ordinal", F.lower("name").alias("key"), F.col("name").alias("source_field"))
        .join(target, ["table", "key"])
        .select("table", "ordinal", "source_field", "target_field", F.lit(True).alias("enabled"))
    )


def as_mappings(rows: DataFrame, table: str) -> list[FieldMapping]:
    """The mapping list of one table; bounded by the table's column count."""
    picked = rows.where(F.col("table") == table).orderBy("ordinal").collect()
    return [FieldMapping(r["source_field"], r["target_field"], r["enabled"]) for r in picked]
