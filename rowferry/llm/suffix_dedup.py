"""Removal of long repeats: every byte inside a 400-byte string that starts anywhere else too, by column-wise construction.

The collection's documents, for the construction, are *contexts*: stretches of text that could hold a repeat, aligned so
that equal strings lie in the same columns.

1. Each 400-byte window has one anchor, the place of its smallest 80-byte hash (the first of equals), so equal windows
   have equal anchors at the same distance. Consecutive windows with one anchor are a run. Texts that are equal as a
   whole are one class; only its runs go on. Runs whose anchor hash occurs nowhere else hold no repeat and are dropped.
2. The other runs' bytes are written out by anchor hash, sorted, and read back in order, so that a group's contexts lie
   together in the exchange's files. Of a batch of groups, one symbol of every context is inserted each round, from the
   last column to the first: contexts are in the order of what follows the column, the column's symbols in that order
   are the transform's piece for it, and sorting stably by them gives the next order. Common prefixes follow in the same
   scan: one more than the least of those between the two old places. Where two neighbours share 400 bytes, both
   windows that start at the column are repeats. Orders and prefixes are exact; hashes only choose what is compared.
3. An anchor with more than ``HOT`` contexts goes another, equally exact way, so that no group is held by one task: its
   runs are cut into pieces of 32 starts, grouped by hashes of the 369 bytes that all of a piece's windows share. Equal
   pieces repeat as they are; of those left, one of each kind is compared column-wise, or, where even the kinds are more
   than ``HOT``, window by window through sums by 128-bit hash.
4. Spans are gathered by class and the remaining bytes digested, once for each class.

A text of equal or periodic stretches would have an anchor in every period; its windows are compared within the text
first, by 128 bits, and one of each kind goes on. A text longer than a slice is cut into overlapping slices, which lose
no window.

Nulls: a null text is empty. Matches never cross texts. Rows that repeat an id, and null ids, are texts like any other:
equal texts of at least 400 bytes are removed whole, in every row. Texts under 400 bytes stay. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.text import slices
from rowferry.session import Staged, remove

LENGTH = 400
ANCHOR = 80
# Contexts at one anchor that are compared within a task.
HOT = 4096
# Contexts whose columns are inserted together, about; and starts of one piece at a hot anchor.
BATCH = 4096
STARTS = 32
# Windows worked on at once, and bytes of contexts in one batch of rows.
SLICE = 1 << 19
OUT_BYTES = 8 << 20

_MASK = (1 << 64) - 1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_RUN = "array<struct<key:long,at:int,lo:int,hi:int>>"
_SPAN = "array<struct<start:int,stop:int>>"


class Rolling:
    """Hashes of all windows of a length, modulo 2^64, from one running sum."""

    def __init__(self, odd: int):
        seed = (np.arange(1, 257, dtype=np.uint64) * np.uint64(odd)) ^ np.uint64(odd >> 7)
        seed ^= seed >> np.uint64(29)
        self.table = seed * np.uint64(0xBF58476D1CE4E5B9)
        self.up = self.down = np.ones(1, np.uint64)
        self.odd, self.inverse = odd, pow(odd, -1, 1 << 64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.odd, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])

    def windows(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        return (total[length:] - total[:-length]) * self.down[: n - length + 1]


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes, the place of the smallest (by 32 mixed bits), the first of equals."""
    mixed = hashes ^ (hashes >> np.uint64(31))
    mixed *= np.uint64(0x94D049BB133111EB)
    packed = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(mixed), dtype=np.uint64)
    m = len(packed) - width + 1
    rows = -(-len(packed) // width)
    grid = np.full(rows * width, _MASK, np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:m], head[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, and each text's bounds. Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(places: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive places (that also agree in ``same``)."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = places[1:] != places[:-1] + 1
    if same is not None:
        cut |= same[1:] != same[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.concatenate([first[1:], [len(places)]]) - 1


def runs_of(data: np.ndarray, offsets: np.ndarray, anchor: Rolling, second: Rolling) -> tuple[np.ndarray, ...]:
    """``doc, key, at, lo, hi`` of all runs, and ``doc, start, stop`` of spans that repeat within their text; places within texts."""
    runs, spans = [], []
    width = LENGTH - ANCHOR + 1
    for begin in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[begin : begin + SLICE + LENGTH - 1]
        m = len(part) - LENGTH + 1
        # Windows that lie within one text.
        first, last = np.searchsorted(offsets, [begin, begin + m - 1], side="right")
        some = np.arange(first - 1, min(last, len(offsets) - 1))
        a, b = np.maximum(offsets[some], begin) - begin, np.minimum(offsets[some + 1] - LENGTH + 1, begin + m) - begin
        change = np.zeros(m + 1, np.int32)
        real = b > a
        np.add.at(change, a[real], 1)
        np.add.at(change, b[real], -1)
        at = np.flatnonzero(np.cumsum(change[:-1]))
        if not len(at):
            continue
        hashes = anchor.windows(part, ANCHOR)
        place = least_places(hashes, width)[at]
        x, y = _segments(at, place)
        doc = np.searchsorted(offsets, begin + at[x], side="right") - 1
        # Texts with many more runs than chance gives: of their windows, one of each kind goes on.
        many, windows = np.bincount(doc, minlength=len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        np.add.at(windows, doc, y - x + 1)
        dense = (many > 8) & (many * (width // 5) > windows)
        if dense.any():
            owner = np.repeat(doc, y - x + 1)
            inside = np.flatnonzero(dense[owner])
            one, two = (r.windows(part, LENGTH)[at[inside]] for r in (anchor, second))
            order = np.lexsort((at[inside], two, one, owner[inside]))
            equal = np.concatenate([[False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]) & (owner[inside][order][1:] == owner[inside][order][:-1])])
            again = np.zeros(len(at), bool)
            again[inside[order[equal]]] = True
            held = again.copy()
            held[inside[order[np.flatnonzero(equal) - 1]]] = True
            hit = np.flatnonzero(held)
            s, t = _segments(at[hit], owner[hit])
            base = offsets[owner[hit][s]]
            spans.append((owner[hit][s], begin + at[hit][s] - base, begin + at[hit][t] + LENGTH - base))
            at, place = at[~again], place[~again]
            x, y = _segments(at, place)
            doc = np.searchsorted(offsets, begin + at[x], side="right") - 1
        base = offsets[doc]
        runs.append((doc, hashes[place[x]].view(np.int64), begin + place[x] - base, begin + at[x] - base, begin + at[y] - base))
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate([r[k] for r in runs] or empty) for k in range(5)) + tuple(np.concatenate([s[k] for s in spans] or empty) for k in range(3))


def _lists(doc: np.ndarray, n: int, fields: list[tuple[str, np.ndarray, pa.DataType]]) -> pa.Array:
    """Structs as one list for each of ``n`` texts; ``doc`` does not fall."""
    ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(v, t) for _, v, t in fields], [k for k, _, _ in fields]))


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchor, second = (Rolling(x) for x in _ODD)
    for batch in slices(batches):
        data, offsets = flat_bytes(batch.column("text"))
        doc, key, at, lo, hi, whose, start, stop = runs_of(data, offsets, anchor, second)
        runs = _lists(doc, len(batch), [("key", key, pa.int64()), ("at", at, pa.int32()), ("lo", lo, pa.int32()), ("hi", hi, pa.int32())])
        spans = _lists(whose, len(batch), [("start", start, pa.int32()), ("stop", stop, pa.int32())])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "same", "sha")), pa.array(np.diff(offsets)), runs, spans], ["doc_id", "same", "sha", "n", "runs", "spans"])


def repeated_starts(group: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which windows repeat, by inserting one symbol of each context a round.

    ``group`` does not fall; ``first`` is the column of a context's first byte, ``data`` all contexts' bytes one after
    the other. The result is ``[context, k]``: whether the window at byte ``k`` of the context starts elsewhere too.
    """
    m, low = len(group), int(first.min())
    columns = int((first + size).max()) - low
    begin = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(begin, size)
    table = np.zeros((columns, m), np.int16)  # 0: no symbol
    table[inside + np.repeat(first - low, size), np.repeat(np.arange(m), size)] = data.astype(np.int16) + 1
    # Group and symbol as one number; a context without a symbol at a column sorts first and has nothing in common.
    base = (np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * 257).astype(np.int32)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    found = np.zeros((columns, m), bool)
    fresh = np.zeros(m + 1, np.int32)
    for column in range(columns - 1, -1, -1):
        symbol = table[column][order]
        place = base[order] + symbol
        step = np.argsort(place, kind="stable") if (place[1:] < place[:-1]).any() else None
        if step is None:
            joined = (place[1:] == place[:-1]) & (symbol[1:] > 0)
            fresh[1:m] = np.where(joined, common[1:m] + 1, 0)
        else:
            order, place, symbol = order[step], place[step], symbol[step]
            joined = (place[1:] == place[:-1]) & (symbol[1:] > 0)
            fresh[1:m] = np.where(joined, common[step[1:]] + 1, 0)
            apart = np.flatnonzero(joined & (step[1:] != step[:-1] + 1))
            if len(apart):
                ends = np.stack([step[apart] + 1, step[apart + 1] + 1], axis=1).ravel()
                fresh[apart + 1] = np.minimum.reduceat(common, ends)[::2] + 1
        np.minimum(fresh, LENGTH, out=common)
        hit = np.flatnonzero(common >= LENGTH)
        if len(hit):
            found[column, order[hit]] = found[column, order[hit - 1]] = True
    out = np.zeros((m, int(size.max()) - LENGTH + 1), bool)
    at = first[:, None] - low + np.arange(out.shape[1])[None, :]
    np.copyto(out, found[np.minimum(at, columns - 1), np.arange(m)[:, None]], where=np.arange(out.shape[1])[None, :] <= (size - LENGTH)[:, None])
    return out


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, first, lo, same, data`` sorted by key to spans ``same, start, stop``."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        key = rows.column("key").to_numpy()
        chunk = rows.column("data").combine_chunks()
        chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk
        data, offsets = flat_bytes(chunk)
        found = repeated_starts(key, rows.column("first").to_numpy().astype(np.int64), np.diff(offsets), data)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        stop = np.nonzero(edge == -1)[1]
        lo = rows.column("lo").to_numpy().astype(np.int64)[row]
        same = rows.column("same").take(pa.array(row, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([same.chunk(0) if isinstance(same, pa.ChunkedArray) else same, pa.array(lo + start, pa.int32()), pa.array(lo + stop - 1 + LENGTH, pa.int32())], ["same", "start", "stop"])

    for batch in batches:
        held.append(batch)
        count += len(batch)
        while count >= BATCH:
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[BATCH - 1], side="left")) or int(np.searchsorted(key, key[0], side="right"))
            if cut == count:  # one group so far
                break
            yield flush(rows.slice(0, cut))
            held, count = rows.slice(cut).to_batches(), count - cut
    if count:
        yield flush(pa.Table.from_batches(held))


def compare_columns(contexts: DataFrame) -> DataFrame:
    """Spans that repeat among contexts of one key."""
    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "same binary, start int, stop int")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    return rows.withColumn("same", F.substring(F.unhex("sha"), 1, 16))


def _with_texts(texts: DataFrame, rows: Staged) -> DataFrame:
    """The text of each class in ``rows``, from the row with its smallest id; repeated rows may bring it again."""
    small = F.broadcast(rows.df) if rows.small else rows.df
    long_ones = texts.where(F.octet_length("text") >= LENGTH).withColumnRenamed("doc_id", "rep")
    return long_ones.select("same", F.coalesce("rep", F.lit(-1)).alias("rep"), F.col("rep").isNull().alias("nameless"), "text").join(small, ["same", "rep", "nameless"])


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices without classes that this task has seen."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        keys = batch.column("same").to_pylist()
        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        if fresh:
            yield batch if len(fresh) == len(batch) else batch.take(pa.array(fresh, pa.int64()))


def _ranges(starts: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of rows with about ``limit`` bytes."""
    total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, stop
        at = stop


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``data[start:start + size]`` of each row as one binary array."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _unpack(batch: pa.RecordBatch, column: str, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Each struct's row and fields."""
    lists = batch.column(column)
    flat = lists.flatten()
    return np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _once(batches):
        data, offsets = flat_bytes(batch.column("text"))
        row, key, at, lo, hi = _unpack(batch, "runs", ("key", "at", "lo", "hi"))
        sizes, starts = hi.astype(np.int64) - lo + LENGTH, offsets[row] + lo
        for a, b in _ranges(starts, sizes, OUT_BYTES):
            same = batch.column("same").take(pa.array(row[a:b], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(lo[a:b] - at[a:b], pa.int32()), pa.array(lo[a:b], pa.int32()), same, _gather(data, starts[a:b], sizes[a:b])], ["key", "first", "lo", "same", "data"])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs at hot anchors as pieces of ``STARTS`` starts, with the hash of what a piece's windows share and of the whole piece."""
    for batch in _once(batches):
        data, offsets = flat_bytes(batch.column("text"))
        out: list[tuple] = []
        for row, key, at, lo, hi in zip(*(x.tolist() for x in _unpack(batch, "runs", ("key", "at", "lo", "hi")))):
            same, text = batch.column("same")[row].as_py(), data[offsets[row] : offsets[row + 1]]
            for block in range((lo - at) // STARTS, (hi - at) // STARTS + 1):
                a, b = max(lo, at + block * STARTS), min(hi, at + block * STARTS + STARTS - 1)
                shared = text[at + block * STARTS + STARTS - 1 : at + block * STARTS + LENGTH].tobytes()
                named = xxhash.xxh3_64_intdigest(shared + key.to_bytes(8, "little", signed=True) + block.to_bytes(4, "little", signed=True))
                whole = hashlib.blake2b(text[a : b + LENGTH].tobytes() + (a - at).to_bytes(4, "little", signed=True), digest_size=16).digest()
                out.append((named - (1 << 64) if named >> 63 else named, whole, same, a - at, a, b))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["key", "whole", "same", "first", "lo", "hi"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, same, first, lo, data in zip(*(batch.column(c).to_pylist() for c in ("key", "same", "first", "lo", "data"))):
            out += [(hashlib.blake2b(data[k : k + LENGTH] + key.to_bytes(8, "little", signed=True) + (first + k).to_bytes(4, "little", signed=True), digest_size=16).digest(), same, lo + k) for k in range(len(data) - LENGTH + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["window", "same", "lo"])


def _hot_spans(texts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, list[Staged]]:
    """Spans that repeat among runs at hot anchors; ``wanted`` holds those runs by class."""
    rows = Staged(wanted, "hot-runs")
    pieces = Staged(_with_texts(texts, rows).mapInArrow(_pieces, "key long, whole binary, same binary, first int, lo int, hi int"), "pieces")
    # One of each kind of piece; the kinds of a key are to be compared.
    kinds = pieces.df.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("same", "lo")).alias("low"))
    kinds = Staged(kinds, "kinds")
    many = Staged(kinds.df.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kind-counts")
    twice = pieces.df.join(kinds.df.where("n > 1").select("key", "whole"), ["key", "whole"]).select("same", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop"))
    # The bytes of one piece of each kind.
    chosen = kinds.df.join(many.df, "key").select("key", "whole", "low.same", "low.lo", "kinds")
    chosen = chosen.join(pieces.df.select("key", "whole", "same", "lo", "first", "hi"), ["key", "whole", "same", "lo"])
    lists = chosen.groupBy("same").agg(F.collect_list(F.struct("key", (F.col("lo") - F.col("first")).alias("at"), "lo", "hi")).cast(_RUN).alias("runs"))
    reps = rows.df.select("same", "rep", "nameless").join(lists, "same")
    bytes_of = Staged(reps, "kind-runs")
    data = Staged(_with_texts(texts, bytes_of).mapInArrow(_contexts, "key long, first int, lo int, same binary, data binary"), "kind-bytes")
    counted = data.df.join(many.df, "key")
    columns = compare_columns(counted.where(F.col("kinds") <= HOT).select("key", "first", "lo", "same", "data"))
    windows = Staged(counted.where(F.col("kinds") > HOT).select("key", "same", "first", "lo", "data").mapInArrow(_windows, "window binary, same binary, lo int"), "windows")
    place = F.xxhash64("same", "lo")
    often = windows.df.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("window")
    single = windows.df.join(often, "window").select("same", F.col("lo").alias("start"), (F.col("lo") + LENGTH).alias("stop"))
    return twice.union(columns).union(single), [rows, pieces, kinds, many, bytes_of, data, windows]


def _remainder(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _once(batches):
        data, offsets = flat_bytes(batch.column("text"))
        row, start, stop = _unpack(batch, "spans", ("start", "stop"))
        ends, out = np.searchsorted(row, np.arange(len(batch) + 1)), []
        for i in range(len(batch)):
            text = data[offsets[i] : offsets[i + 1]]
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, start[ends[i] : ends[i + 1]], 1)
            np.add.at(depth, stop[ends[i] : ends[i + 1]], -1)
            gone = np.cumsum(depth[:-1]) > 0
            edges = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            out.append((int(gone.sum()), edges, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("same"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["same", "n_removed", "n_spans", "kept"])


def _run_lists(tokens: DataFrame, extra: tuple[Column, ...]) -> DataFrame:
    return tokens.groupBy("same", *extra).agg(F.collect_list(F.struct("key", "at", "lo", "hi")).alias("runs"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    spark, texts = docs.sparkSession, _texts(docs)
    sketch = texts.select("doc_id", "same", "sha", "text").mapInArrow(_sketch, f"doc_id long, same binary, sha string, n long, runs {_RUN}, spans {_SPAN}")
    held = Staged(sketch, "sketch")
    long_ones = held.df.where(F.col("n") >= LENGTH)
    # A class for each text; its runs and spans are those of any of its rows.
    classes = long_ones.groupBy("same").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("runs").alias("runs"), F.first("spans").alias("spans"))
    classes = Staged(classes.select("same", "copies", F.coalesce("rep", F.lit(-1)).alias("rep"), F.col("rep").isNull().alias("nameless"), "runs", "spans"), "classes")
    tokens = classes.df.select("same", "rep", "nameless", F.explode("runs").alias("run")).select("same", "rep", "nameless", "run.*")
    often = Staged(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"), "anchors")
    met = tokens.join(F.broadcast(often.df) if often.small else often.df, "key")
    spare = [held, classes, often]
    wanted = Staged(_run_lists(met.where(F.col("seen") <= HOT), ("rep", "nameless")), "runs")
    contexts = _with_texts(texts, wanted).mapInArrow(_contexts, "key long, first int, lo int, same binary, data binary")
    spans = [Staged(compare_columns(contexts), "spans")]
    if often.df.where(F.col("seen") > HOT).limit(1).count():
        hot, used = _hot_spans(texts, _run_lists(met.where(F.col("seen") > HOT), ("rep", "nameless")))
        spans.append(Staged(hot, "hot-spans"))
        for done in used:
            remove(spark, done.path)
    for done in (wanted, often):
        remove(spark, done.path)
    own = classes.df.select("same", F.explode("spans").alias("span")).select("same", "span.*")
    every = own
    for some in spans:
        every = every.union(some.df)
    # Texts that stand in several rows go whole; of the others, what remains is digested with the text at hand.
    lone = classes.df.where("copies = 1").select("same", "rep", "nameless")
    partly = Staged(every.groupBy("same").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(lone, "same"), "partly")
    left = Staged(_with_texts(texts, partly).mapInArrow(_remainder, "same binary, n_removed long, n_spans long, kept string"), "left")
    for done in (*spans, partly):
        remove(spark, done.path)
    copied = classes.df.where("copies > 1").select("same", F.lit(True).alias("copied"))
    out = held.df.select("doc_id", "same", "sha", "n").join(left.df, "same", "left").join(copied, "same", "left")
    whole = F.coalesce("copied", F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
