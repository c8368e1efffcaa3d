"""Row merges by key: append with a guard, skip existing, upsert and whole-row replace.

The target holds one row per key. Input rows are reduced to one per key before
they meet it: ``row_number() = 1`` is cut down inside each map task first
(window group limit), so a key with a third of all input rows still ships one
row per map task, and the join behind it never multiplies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowferry.operators.mapping import column


class DuplicateKey(ValueError):
    """An insert met a key that is already there."""


def hash_parts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """What to hash of columns so that unlike rows differ: a null leaves a trace in its place, maps go by their entries."""
    parts: list[Column] = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        parts += [column(c).isNull(), F.to_json(F.struct(column(c).alias("v"))) if "map<" in kind or kind == "variant" else column(c)]
    return parts


def _one_per_key(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    # The row hash breaks ties, so a task retry picks the same row again.
    ties = F.xxhash64(*hash_parts(df, df.columns))
    w = Window.partitionBy(*[column(k) for k in keys]).orderBy(*order, ties)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order_by``."""
    return _one_per_key(df, keys, [column(c).desc_nulls_last() for c in order_by])


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order_by``."""
    return _one_per_key(df, keys, [column(c).asc_nulls_last() for c in order_by])


def require_keys(keys: Sequence[str], columns: Sequence[str]) -> None:
    if not keys:
        raise ValueError("this write needs the key columns of the target")
    missing = [k for k in keys if k not in columns]
    if missing:
        raise ValueError(f"key columns missing from the target: {', '.join(missing)}")


def duplicate_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys an insert would violate: repeated in the input, or already in the target.

    Both sides are counted in one aggregate over their keys alone, which combines
    in the map tasks, so neither repeats nor a large target cost a row join.
    """
    require_keys(keys, target.columns)
    new = source.select([column(k) for k in keys]).withColumn("n_new", F.lit(1)).withColumn("n_old", F.lit(0))
    old = target.select([column(k) for k in keys]).withColumn("n_new", F.lit(0)).withColumn("n_old", F.lit(1))
    return (
        new.unionByName(old)
        .groupBy(*[column(k) for k in keys])
        .agg(F.sum("n_new").alias("new_rows"), F.sum("n_old").alias("existing_rows"))
        .where("new_rows > 0 AND new_rows + existing_rows > 1")
    )


def insert_checked(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to append, after proving that none repeats a key."""
    first = duplicate_keys(target, source, keys).first()
    if first is not None:
        raise DuplicateKey(f"duplicate key {tuple(first[k] for k in keys)}")
    return source


def insert_skip(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str], null_keys: bool = True
) -> DataFrame:
    """The rows to append when existing keys are skipped; of repeated new keys the first stays."""
    require_keys(keys, target.columns)
    return _match(keep_first(source, keys, order_by), target, keys, "left_anti", null_keys)


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_keys: bool = True) -> DataFrame:
    """Join on the keys that keeps the left columns only; null keys are equal unless there are none."""
    r = right.select([column(k).alias(f"_r{i}") for i, k in enumerate(keys)])
    on = [column(k).eqNullSafe(F.col(f"_r{i}")) if null_keys else column(k) == F.col(f"_r{i}") for i, k in enumerate(keys)]
    return left.join(r, on, how)


def has_null_keys(df: DataFrame, keys: Sequence[str]) -> bool:
    return not df.where(reduce(lambda a, b: a | b, [column(k).isNull() for k in keys])).isEmpty()


def outer_match(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    change_keys: Sequence[str],
    small: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """Full outer join of a target with changes that hold one row per key; null keys are equal.

    Changes known to hold no null key (``null_keys=False``) join by plain
    equality to the same result, which lets Spark reuse a partitioning by the
    key: that of the step that settled the changes, or of a bucketed target.

    ``small`` changes (a size the caller has checked) are broadcast instead:
    target rows stay where they are, and the changes without a target row are
    added behind them. Then the target is not shuffled at all.
    """
    def same(a: str, b: str) -> Column:
        return column(a).eqNullSafe(column(b)) if null_keys else column(a) == column(b)

    on = [same(k, c) for k, c in zip(keys, change_keys)]
    if not small:
        return target.join(changes, on, "full_outer")
    side = F.broadcast(changes)
    held = target.select([column(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    seen = [same(f"_h{i}", c) for i, c in enumerate(change_keys)]
    present = held.join(F.broadcast(changes.select([column(c) for c in change_keys])), seen, "left_semi").distinct()
    return target.join(side, on, "left").unionByName(changes.join(present, seen, "left_anti"), allowMissingColumns=True)


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str], null_keys: bool = True
) -> DataFrame:
    """The whole target after the upsert.

    A matched row takes every non-key input column and keeps the columns only
    the target has; an unmatched row is added. Repeated input keys: last wins.
    An input that holds nothing but keys only adds the missing ones.
    """
    require_keys(keys, target.columns)
    return upsert_settled(target, keep_last(source, keys, order_by), keys, null_keys=null_keys)


def upsert_settled(
    target: DataFrame, fresh: DataFrame, keys: Sequence[str], small: bool = False, null_keys: bool = True
) -> DataFrame:
    """``upsert`` of an input that holds one row per key."""
    extra = [c for c in fresh.columns if c not in target.columns]
    if extra:
        raise ValueError(f"columns missing from the target: {', '.join(extra)}")
    s = fresh.select([column(c).alias(f"_s{i}") for i, c in enumerate(fresh.columns)]).withColumn("_in_source", F.lit(True))
    at = {c: F.col(f"_s{i}") for i, c in enumerate(fresh.columns)}
    joined = outer_match(target, s, keys, [f"_s{fresh.columns.index(k)}" for k in keys], small, null_keys)
    hit = F.col("_in_source").isNotNull()
    types = {f.name: f.dataType for f in target.schema.fields}
    return joined.select(
        [
            (F.when(hit, at[c].cast(types[c])).otherwise(column(c)) if c in at else column(c)).alias(c)
            for c in target.columns
        ]
    )


def replace_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The whole target after a document replace: a matched row is swapped for the input row as it is.

    Fields the input lacks vanish from replaced rows; fields only the input has
    are added to the schema.
    """
    require_keys(keys, target.columns)
    return replace_settled(target, keep_last(source, keys, order_by), keys)


def replace_settled(
    target: DataFrame, fresh: DataFrame, keys: Sequence[str], small: bool = False, null_keys: bool = True
) -> DataFrame:
    """``replace_rows`` of an input that holds one row per key."""
    gone = F.broadcast(fresh) if small else fresh
    return _match(target, gone, keys, "left_anti", null_keys).unionByName(fresh, allowMissingColumns=True)
