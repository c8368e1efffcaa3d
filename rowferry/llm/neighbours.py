"""Exact nearest neighbours by a block matrix join: int8 tiles with error bounds, float for what survives, heaps to merge.

Rows are dealt into tiles of bounded size by a hash of their id. Every tile of
queries meets every tile of candidates once, by an equality join on the pair of
tiles. Within a pair an int8 product bounds each distance from both sides; a
candidate whose lower bound lies above the k-th smallest upper bound is out, all
others are measured in double precision on the original vectors.

Nulls: rows with a null id or vector, null or non-finite components, or only
zeros take no part. Vectors meet others of their own length only. A row is never
a neighbour of its own id. Rows that repeat an id are candidates each; a query
id that repeats is searched by its smallest vector. Ties go to the smaller id.
With fewer than k candidates all are returned. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

QUERY_TILE, TILE = 1024, 8192
_STRIP = 64  # queries of a tile bounded at once


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers up to 127, their scale, the norm of what they stand for and the norm of what rounding took away."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    whole = np.rint(x / scale)
    back = whole * scale
    # Held as float32, in which sums of such products are exact up to 2**24, that is for about a thousand dimensions.
    return whole.astype(np.float32), scale[:, 0], np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += np.square(a[:, i].astype(np.float64) - b[:, i].astype(np.float64))
    return np.sqrt(total)


def nearest_in_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest of the tile: query id, id, distance."""
    slack = 4 * queries.shape[1] * np.finfo(np.float32).eps
    qw, qs, qn, qe = _int8(queries)
    cw, cs, cn, ce = _int8(vectors)
    q2, c2 = np.square(queries.astype(np.float64)).sum(axis=1), np.square(vectors.astype(np.float64)).sum(axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), _STRIP):
        s = slice(a, a + _STRIP)
        own = query_ids[s, None] == ids[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            dot = (qw[s] @ cw.T).astype(np.float64) * qs[s, None] * cs[None, :]
            around = q2[s, None] + c2[None, :]
            # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|
            error = 2 * (qe[s, None] * np.sqrt(c2)[None, :] + qn[s, None] * ce[None, :]) + slack * around
            middle = around - 2 * dot
            low, high = middle - error, middle + error
        # Where numbers leave the range of doubles, nothing is known before the exact measure.
        low[~np.isfinite(low)] = -np.inf
        high[own | ~np.isfinite(high)] = np.inf
        bound = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.full((len(high), 1), np.inf)
        i, j = np.nonzero((low <= bound) & ~own)
        d = _exact(queries[s][i], vectors[j])
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        out.append((query_ids[s][i[place < k]], ids[j[place < k]], d[place < k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query row against all rows."""
    live = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = live.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    tiles, query_tiles = max(1, -(-size["n"] // tile)), max(1, -(-size["q"] // query_tile))
    # Whole numbers of one type on both sides: a cogroup does not cast its keys, and an int and a long of one value hash apart.
    dealt = live.select("id", "v", "q", F.size("v").alias("width"), *[F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int").alias(x) for seed, n, x in ((3, tiles, "c"), (5, query_tiles, "t"))])
    queries = dealt.where("q").groupBy("id", "width", "t").agg(F.min("v").alias("v")).select("id", "v", "width", "t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("c"))
    # Columns of their own, as both sides come from one frame.
    candidates = dealt.select(*[F.col(x).alias(x) for x in ("id", "v", "width", "c")], F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("t"))
    pair = ["width", "t", "c"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        found = nearest_in_tile(left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k)
        return pa.table(list(found), schema=schema)

    def merge(found: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip(found.column("score").to_pylist(), found.column("vec_id").to_pylist()))
        n = len(best)
        return pa.table([pa.array([found.column("query_id")[0].as_py()] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([b for _, b in best], pa.int64()), pa.array([a for a, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    found = queries.groupBy(*pair).cogroup(candidates.groupBy(*pair)).applyInArrow(product, "query_id long, vec_id long, score double")
    return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
