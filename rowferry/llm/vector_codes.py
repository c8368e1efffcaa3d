"""Vector codes: vectors cut into parts, each part the number of its nearest entry in a small codebook, all in integers.

1. A component ``x`` becomes ``floor(4096 x)``; a codebook starts as that part of the vectors with the smallest ids.
2. A round sends the codebooks to all tasks. A task finds nearest entries for a batch by matrix products: integers are
   cut into limbs of 20 bits, so that each product of limbs is below 2^53 and exact in double precision; products are put
   together again in 64-bit integers, and the first smallest distance wins. It gives back one sum and count for each
   entry, which are added up by Spark; the driver holds codebooks and their sums only.
3. After the last round all parts are assigned again.

Exact as long as distances fit 64 bits; a larger component than that allows is an error, never a wrong code.

Nulls: a null vector, an empty one, and one with a null or non-finite component takes no part. Nor does a vector of
another length than most have (ties: the longer). A null id sorts behind all others and keeps its row. Rows that repeat
an id all get codes; for a codebook's start an id counts once, by its smallest vector. With fewer ids than entries the
codebook is as much shorter, and with none there are no codes. A null label is a label. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowferry.session import Staged

SCALE = 4096
LIMB = 20


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers as doubles of ``LIMB`` bits each, lowest first; the last one holds the sign."""
    out, rest = [], x
    while True:
        low = rest & ((1 << LIMB) - 1)
        high = rest >> LIMB
        if not len(x) or ((rest < (1 << LIMB)) & (rest >= -(1 << LIMB))).all():
            return [*out, rest.astype(np.float64)]
        out.append(low.astype(np.float64))
        rest = high


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two integer matrices, exact while they fit 64 bits."""
    if x.shape[1] << (2 * LIMB) >= 1 << 53:
        raise ValueError(f"parts of {x.shape[1]} components are too long for exact products")
    out = np.zeros((len(x), len(y)), np.int64)
    left, right = limbs(x), limbs(y)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (LIMB * (i + j))
    return out


def nearest_entries(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance."""
    square = np.einsum("ij,ij->i", codebook, codebook)
    far = square - 2 * dots(x, codebook)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code] + np.einsum("ij,ij->i", x, x)


def whole_numbers(flat: np.ndarray, width: int) -> np.ndarray:
    """``floor(SCALE x)`` as rows of ``width``; an error where squared distances could leave 64 bits."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if len(scaled) and width * 4 * float(np.abs(scaled).max()) ** 2 >= 2.0**62:
        raise ValueError(f"a component of {np.abs(flat).max():g} is too large for exact 64-bit distances of {width} components")
    return scaled.astype(np.int64).reshape(-1, width)


def kept_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components one after the other."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == width)
    flat = vectors.take(pa.array(rows, pa.int64())).flatten()
    grid = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # a null component becomes NaN
    fit = np.isfinite(grid).all(axis=1)
    return rows[fit], grid[fit].ravel()


def _usual_width(vectors: DataFrame) -> int:
    sizes = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    return top["width"] if top else 0


def first_codebooks(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """``[part, entry, position]`` from the vectors with the smallest ids."""
    if not width:
        return np.zeros((parts, 0, 0), np.int64)
    fit = vectors.where((F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Bounded: one row for each entry.
    ids = [r[0] for r in fit.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    got = fit.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect() if ids else []
    whole = whole_numbers(np.array([x for r in got for x in r["vector"]], np.float64), width)
    return whole.reshape(len(got), parts, width // parts).transpose(1, 0, 2).copy()


def sum_entries(vectors: DataFrame, codebooks: np.ndarray, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sums of the parts nearest to each entry."""
    parts, entries, length = codebooks.shape

    def assign(batches: Iterable[pa.RecordBatch]):
        count, sums = np.zeros((parts, entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            x = whole_numbers(kept_rows(batch.column("vector"), width)[1], width)
            for p in range(parts):
                own = x[:, p * length : (p + 1) * length]
                code, _ = nearest_entries(own, codebooks[p])
                np.add.at(sums[p], code, own)
                count[p] += np.bincount(code, minlength=entries)
        at = np.flatnonzero(count)
        if len(at):
            # Two halves of a sum, as adding up the whole ones could leave 64 bits.
            picked = sums.reshape(-1, length)[at]
            halves = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * 2 * length, np.concatenate([picked >> 32, picked & 0xFFFFFFFF], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at // entries), pa.array(at % entries), pa.array(count.ravel()[at]), halves], ["part", "entry", "n", "halves"])

    found = vectors.select("vector").mapInArrow(assign, "part long, entry long, n long, halves array<long>")
    each = [F.sum(F.col("halves")[k]).alias(f"s{k}") for k in range(2 * length)]
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()
    return {(r["part"], r["entry"]): (r["n"], [(r[f"s{k}"] << 32) + r[f"s{length + k}"] for k in range(length)]) for r in rows}


def fit_codebooks(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    codebooks = first_codebooks(vectors, width, parts, entries)
    for _ in range(rounds if codebooks.size else 0):
        for (part, entry), (n, sums) in sum_entries(vectors, codebooks, width).items():
            codebooks[part, entry] = [s // n for s in sums]
    return codebooks


def compress(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every vector that takes part."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").alias("label"))
    width = _usual_width(vectors)
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    codebooks = fit_codebooks(vectors, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel())).encode()).hexdigest()
    length = width // parts

    def encode(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows, flat = kept_rows(batch.column("vector"), width) if codebooks.size else (np.zeros(0, np.int64), None)
            if not len(rows):
                continue
            x = whole_numbers(flat, width)
            found = [nearest_entries(x[:, p * length : (p + 1) * length], codebooks[p]) for p in range(parts)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = sum(e for _, e in found)
            some = batch.select(["vec_id", "label"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    coded = Staged(vectors.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"), "codes").df
    sums = Staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = sums.df.withColumnRenamed("label", "of_label")
    # Null labels are one label; elsewhere a plain join, whose hot labels are split as they are found.
    by_label = F.broadcast(by_label) if sums.small else by_label
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
