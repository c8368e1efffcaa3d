"""Connected components of an edge list by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowferry.session import Staged, remove


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of an edge that joins two different ones; the root is the smallest node reachable.

    Each round points all neighbours of a node at its smallest one. Minima are aggregated map-side and met again by a
    plain join, so a node with very many neighbours is split like any skewed join. Null ends make no edge.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    held = Staged(now, "edges")
    before = _mark(held.df)
    for _ in range(most_rounds):
        both = held.df.union(held.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, held = held, Staged(small, "edges")
        after = _mark(held.df)
        remove(edges.sparkSession, last.path)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = held.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
