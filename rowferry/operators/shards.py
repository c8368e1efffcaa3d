"""Key-range shards of one table, and the bounds they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowferry.operators.mapping import column
from rowferry.operators.paging import TotalOrder

# Fixed value: the most connections a sharded read opens against one source database.
MAX_SOURCE_SHARDS = 8


def check_shards(n: int, most: int = MAX_SOURCE_SHARDS) -> int:
    """The number of shards to cut, at least one; more than allowed is an error, never fewer than asked."""
    if n > most:
        raise ValueError(f"{n} shards exceed the {most} connections allowed; raise max_shards for this source")
    return max(1, n)


@dataclass(frozen=True)
class KeyRange:
    """``n`` equal steps over ``[low, high]``; the last step is open-ended."""

    low: int
    high: int
    n: int

    @property
    def step(self) -> int:
        return (self.high - self.low + self.n) // self.n

    def predicates(self, key: str) -> list[str]:
        """One SQL predicate per shard; null keys go with the first, so the shards cover every row."""
        name = "`" + key.replace("`", "``") + "`"
        out = []
        for i in range(self.n):
            low = self.low + i * self.step
            parts = [] if i == 0 else [f"{name} >= {low}"]
            if i < self.n - 1:
                parts.append(f"{name} < {low + self.step}")
            text = " AND ".join(parts) or "true"
            out.append(f"({text} OR {name} IS NULL)" if i == 0 and parts else text)
        return out

    def shard_of(self, key: str) -> Column:
        """The shard number of each row."""
        name = "`" + key.replace("`", "``") + "`"
        at = F.expr(f"({name} - {self.low}) div {self.step}").cast("int")
        return F.coalesce(F.greatest(F.lit(0), F.least(at, F.lit(self.n - 1))), F.lit(0))


# Keys that cuts are taken from: an edge is off by about half a percent of the rows at most, whatever their number.
SAMPLE = 1 << 16


@dataclass(frozen=True)
class Cuts:
    """Ranges of a key of any type with about as many rows each; ``edges`` are SQL literals in ascending order."""

    edges: tuple[str, ...]

    def predicates(self, key: str) -> list[str]:
        """One SQL predicate per range; null keys go with the first, so the ranges cover every row."""
        name = "`" + key.replace("`", "``") + "`"
        return edge_predicates(name, self.edges)

    def shard_of(self, key: str) -> Column:
        """The range of each row, by as many comparisons as log2 of the edges."""
        name = "`" + key.replace("`", "``") + "`"

        def tree(lo: int, hi: int) -> str:
            if lo == hi:
                return str(lo)
            mid = (lo + hi) // 2
            return f"CASE WHEN {name} >= {self.edges[mid]} THEN {tree(mid + 1, hi)} ELSE {tree(lo, mid)} END"

        return F.expr(tree(0, len(self.edges))).cast("int")


def edge_predicates(name: str, edges: tuple[str, ...]) -> list[str]:
    """``name`` and ``edges`` as they stand in the source's SQL."""
    if not edges:
        return ["true"]
    first = f"({name} < {edges[0]} OR {name} IS NULL)"
    inner = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(edges, edges[1:])]
    return [first, *inner, f"{name} >= {edges[-1]}"]


def balanced_cuts(df: DataFrame, key: str, n: int, sample: int = SAMPLE) -> Cuts:
    """Cuts into ``n`` ranges with like numbers of rows, for numbers, texts, dates and timestamps.

    The edges are quantiles of about ``sample`` rows drawn at random from all of
    them, so a dense stretch of keys is cut as often as its rows ask for. Rows of
    one key are never parted: a key with more than its share leaves fewer ranges.
    """
    order = TotalOrder(df.select(column(key)), [key])
    keys = df.select(column(key)).where(column(key).isNotNull())
    rate = sample / max(1, keys.count())
    drawn = keys if rate >= 1 else keys.where(F.rand(29) < rate)
    # About ``sample`` keys reach the driver, sorted by the engine.
    found = order.literals_of(drawn.orderBy(column(key)))
    picked = [found[len(found) * i // n] for i in range(1, n)] if found else []
    edges = [e for e in dict.fromkeys(picked) if e != found[0]]
    return Cuts(tuple(edges))


def is_integer_key(df: DataFrame, key: str) -> bool:
    """Judged by the column's Spark type; an unsized whole-number decimal counts."""
    kind = df.schema[key].dataType
    return isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """One row ``(low, high)``, zero for an empty table."""
    c = column(key)
    return df.agg(
        F.coalesce(F.min(c), F.lit(0)).cast("long").alias("low"),
        F.coalesce(F.max(c), F.lit(0)).cast("long").alias("high"),
    )


def key_range(df: DataFrame, key: str, n: int) -> KeyRange:
    """The shard plan of a table; reads one aggregate row (answered from parquet statistics or the source)."""
    low, high = key_bounds(df, key).first()
    return KeyRange(low, high, max(1, n))


def balanced_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per balanced range."""
    cuts = balanced_cuts(df, key, n)
    return df.select(cuts.shard_of(key).alias("shard")).groupBy("shard").agg(F.count("*").alias("rows"))


def union_of_ranges(df: DataFrame, key: str, n: int) -> DataFrame:
    """The table read range by range, each a filtered scan, and put together again; equals the table itself."""
    parts = [df.where(p) for p in balanced_cuts(df, key, n).predicates(key)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_shard(df: DataFrame, key: str, n: int, out: str = "shard") -> DataFrame:
    """Add the shard number: equal key steps for integer keys, a hash of the key for any other type."""
    if is_integer_key(df, key):
        return df.withColumn(out, key_range(df, key, n).shard_of(key))
    return df.withColumn(out, F.pmod(F.xxhash64(column(key)), F.lit(n)).cast("int"))


def shard_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per shard."""
    return with_shard(df.select(column(key)), key, n).groupBy("shard").agg(F.count("*").alias("rows"))


def union_of_shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """The table read shard by shard and put together again; equals the table itself.

    Every branch is a filtered scan, so the predicate reaches the source.
    """
    if not is_integer_key(df, key):
        return df
    parts = [df.where(p) for p in key_range(df, key, n).predicates(key)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
