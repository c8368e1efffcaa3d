"""Tables without a key as bags: each distinct row once, with how often it is there.

A bag is keyed by a hash of the whole row, so the few rows that a batch of changes concerns are found by key. A delete
names the values of some columns and takes every older row that has them, however often it is there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from rowferry.operators.changes import apply_keyless, convert
from rowferry.operators.mapping import column

ROW_KEY, COUNT = "_row_key", "_copies"
# Equal rows made by one task when a bag is written out.
_BLOCK = 1_000_000


def as_bag(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows with their key and count; equal rows are counted before they move."""
    whole = F.to_json(F.struct(*[column(c) for c in columns]), {"ignoreNullFields": "false"})
    counted = rows.groupBy(*[column(c) for c in columns]).agg(F.count(F.lit(1)).alias(COUNT))
    return counted.select(F.sha2(whole, 256).alias(ROW_KEY), *[column(c) for c in columns], COUNT)


def from_bag(bag: DataFrame) -> DataFrame:
    """The rows themselves; a row with very many copies is made in blocks that any task can take."""
    blocks = bag.withColumn("_block", F.explode(F.expr(f"sequence(0L, ({COUNT} - 1) div {_BLOCK})")))
    rest = F.least(F.lit(_BLOCK).cast("long"), F.col(COUNT) - F.col("_block") * _BLOCK)
    rows = blocks.withColumn("_rest", rest).hint("rebalance").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rest"))))
    return rows.drop(ROW_KEY, COUNT, "_block", "_rest", "_copy")


def deleted_keys(bag: DataFrame, feed: DataFrame) -> DataFrame:
    """Keys of the bag's rows that some delete names: an equi-join for each set of columns that deletes name."""
    fields = [c for c in feed.schema["after"].dataType.names if c in bag.columns]
    image = F.coalesce("before", "after") if "before" in feed.columns else F.col("after")
    gone = feed.where("op = 'D'").select(*[image[c].alias(c) for c in fields])
    gone = gone.withColumn("_set", F.concat_ws(",", *[F.when(column(c).isNotNull(), F.lit(str(i))) for i, c in enumerate(fields)]))
    out = bag.select(ROW_KEY).limit(0)
    for (pattern,) in gone.select("_set").distinct().where("_set <> ''").collect():
        cols = [fields[int(i)] for i in pattern.split(",")]
        named = gone.where(F.col("_set") == pattern).select(*[column(c) for c in cols]).distinct()
        out = out.union(bag.join(named, cols, "left_semi").select(ROW_KEY))
    return out.distinct()


def bag_fields(table: T.StructType, image: T.StructType) -> list[T.StructField]:
    """The columns of a bag's rows after a feed: its own, and those only the feed has."""
    own = [f for f in table.fields if f.name not in (ROW_KEY, COUNT)]
    return own + [f for f in image.fields if f.name not in table.names]


def surviving_inserts(feed: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Rows that a feed adds and does not itself take away later, as a bag in the table's types."""
    image = feed.schema["after"].dataType
    rows = apply_keyless(feed.select("after.*").limit(0), feed)
    typed = [convert(column(f.name), image[f.name].dataType, f.dataType) if f.name in image.names else F.lit(None).cast(f.dataType) for f in fields]
    return as_bag(rows.select(*[c.alias(f.name) for c, f in zip(typed, fields)]), [f.name for f in fields])


def merge_bag(old: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """Some buckets of a bag after a batch: rows named by a delete go, added ones are counted in."""
    kept = old.join(gone, ROW_KEY, "left_anti").select(*[column(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in added.schema.fields])
    rest = [c for c in added.columns if c not in (ROW_KEY, COUNT)]
    return kept.union(added).groupBy(ROW_KEY).agg(*[F.first(column(c)).alias(c) for c in rest], F.sum(COUNT).alias(COUNT))
