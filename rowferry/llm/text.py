"""Words of a batch of texts as dictionary codes: split and encoded by Arrow, so Python sees each distinct word once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Characters of text worked on at once within a task.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of whole rows with about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(size):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text ``i``, as indexes into ``vocabulary``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: list[str]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of characters other than ASCII white space; ``lower`` lower-cases A-Z only. Null has none."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, flat = split.offsets.to_numpy().astype(np.int64), split.flatten()
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "")
    if not pc.all(real).as_py() and len(flat):
        kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        offsets, flat = kept[offsets], flat.filter(real)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary.to_pylist())


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows kept away from learning: crc32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def share(key: Column, rate: Column | float, seed: int = 17) -> Column:
    """A repeatable part of the rows, chosen by their key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(float(1 << 30)) * rate
