"""Packing of token sequences by linear grouping and best fit, planned on the histogram of lengths.

Texts are tokenised in tasks and cut into pieces no longer than a sequence. Only
the number of pieces of each length, at most as many numbers as a sequence has
tokens, comes to the driver. There the large lengths are rounded up within
groups of equal cardinality, configurations of few sizes are chosen by a
bounded knapsack, the real lengths take the places of the rounded ones, and
small pieces are put in by best fit. All of it moves whole runs of equal
pieces, so planning costs the same for any number of them. The plan says for
each run of pieces of one length where its first goes; tasks number the pieces
of a length and look their places up.

Nulls: a null text is an empty one, a piece of one closing token. A null
``doc_id`` is carried along. Repeated rows are packed each. Pieces of equal
length are interchangeable; which goes where follows their order of reading.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowferry.llm.text import slices, words_of
from rowferry.session import Staged

CAPACITY = 4096
CLOSING = 1
# Groups of equal cardinality for large pieces; pieces up to SMALL part of a sequence are put in by best fit.
GROUPS = 96
SMALL = 1 / 8
# Distinct words whose ids a task keeps; then it starts afresh.
KEPT_WORDS = 700_000


# A word of Latin letters, perhaps with a mark behind it: nothing in it is composed, split or lower-cased by context.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
_JOINED = 200  # plain words encoded as one text


class Ids:
    """Token ids of whole texts, tokenising each distinct word once: no token of this vocabulary crosses white space.

    Plain words skip the normaliser and the splitting pattern, which leave them as they are but for case; they are
    encoded many at a time and told apart by the vocabulary's word ends.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.plain = Tokenizer.from_file(tokenizer_path), Tokenizer.from_file(tokenizer_path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [(self.full.id_to_token(i) or "").endswith("</w>") for i in range(self.full.get_vocab_size())]
        self.ends_word = np.array(ends, bool)
        marks = {c: self.full.encode(c, add_special_tokens=False).ids for c in ".,;:!?"}
        self.marks = {c: ids[0] for c, ids in marks.items() if len(ids) == 1}
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}  # of a word, its row
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """A row for each word, whose ids follow one another."""
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.size) < self.count + len(words):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.used : self.used + len(ids)] = ids
        rows = slice(self.count, self.count + len(words))
        self.size[rows], self.begin[rows] = size, self.used + np.cumsum(size) - size
        self.index.update(zip(words, range(rows.start, rows.stop)))
        self.used, self.count = self.used + len(ids), rows.stop

    def _learn(self, fresh: list[str]) -> None:
        """Rows for words without one. Plain words that differ in case share one; a mark adds its id to the bare word's."""
        index, match, bare, marked, rest = self.index, PLAIN.fullmatch, [], [], []
        for w in fresh:
            m = match(w)
            if m is None:
                rest.append(w)
            elif not m[2]:
                bare.append((w, m[1].lower()))
            elif m[2] in self.marks:
                marked.append((w, m[1].lower(), m[2]))
            else:
                rest.append(w)
        new = list(dict.fromkeys(b for _, b, *_ in (*bare, *marked) if b not in index))
        if new:
            joined = [" ".join(new[i : i + _JOINED]) for i in range(0, len(new), _JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
            self._add(new, ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))
        index.update((w, index[b]) for w, b in bare)
        if marked:
            at = np.fromiter((index[b] for _, b, _ in marked), np.int64, len(marked))
            n = self.size[at]
            ends = np.cumsum(n + 1)
            ids, body = np.empty(ends[-1], np.uint32), np.ones(ends[-1], bool)
            ids[ends - 1], body[ends - 1] = np.fromiter((self.marks[c] for *_, c in marked), np.uint32, len(marked)), False
            ids[body] = self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            self._add([w for w, *_ in marked], ids, n + 1)
        if rest:
            each = [e.ids for e in self.full.encode_batch_fast(rest, add_special_tokens=False)]
            size = np.fromiter(map(len, each), np.int64, len(each))
            self._add(rest, np.fromiter((x for one in each for x in one), np.uint32, int(size.sum())), size)

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > KEPT_WORDS:
            self._reset()
        get = self.index.get
        at = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            self._learn(fresh)
            at[new] = np.fromiter([self.index[w] for w in fresh], np.int64, len(fresh))
        return at

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text closed by its closing id, and each text's bounds."""
        words = words_of(texts)
        row = self._rows(words.vocabulary)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        size = self.size[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.begin[row] - ends[:-1], size) + np.arange(ends[-1])
        bounds = ends[words.offsets] + np.arange(len(words.offsets))
        out = np.full(bounds[-1], CLOSING, np.uint32)
        body = np.ones(bounds[-1], bool)
        body[bounds[1:] - 1] = False
        out[body] = self.flat[source]
        return out, bounds


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: ``(length, first, after, sequence, offset)``.

    Piece number ``r`` of a length, ``first <= r < after``, goes to sequence ``sequence + r - first`` at ``offset``.
    """
    ranges: list[tuple[int, int, int, int, int]] = []
    next_sequence = 0
    open_by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
    large = sorted((n for n in histogram if n > capacity * small), reverse=True)
    total = sum(histogram[n] for n in large)

    # Rounding: runs of (length, first piece, count), longest first, cut into groups of equal cardinality.
    each = -(-total // groups) if total else 1
    rounded: list[int] = []
    members: list[list[list[int]]] = []
    room = 0
    for n in large:
        first, left = 0, histogram[n]
        while left:
            if not room:
                rounded.append(n)
                members.append([])
                room = each
            take = min(room, left)
            members[-1].append([n, first, take])
            first, left, room = first + take, left - take, room - take
    left_of = [sum(m[2] for m in g) for g in members]

    # Configurations: the largest size left with the best filling of what it leaves open, as often as the counts allow.
    while any(left_of):
        lead = next(i for i, c in enumerate(left_of) if c)
        use = {lead: 1}
        for i, k in _fill(capacity - rounded[lead], rounded, [c - (i == lead) for i, c in enumerate(left_of)]).items():
            use[i] = use.get(i, 0) + k
        times = min(left_of[i] // k for i, k in use.items())
        slots = [_take(members[i], times) for i, k in sorted(use.items()) for _ in range(k)]
        for i, k in use.items():
            left_of[i] -= times * k
        # Real lengths in place of the rounded ones: stretches of sequences over which no slot changes its length.
        cuts = sorted({0, times} | {x for runs in slots for x in np.cumsum([c for _, _, c in runs]).tolist()})
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for runs in slots:
                n, first = _at(runs, a)
                ranges.append((n, first, first + b - a, next_sequence + a, offset))
                offset += n
            open_by_gap[capacity - offset].append((next_sequence + a, b - a))
        next_sequence += times

    # Small pieces, longest first, each into the fullest sequence that takes it.
    gaps = sorted(g for g in open_by_gap if g)
    for n in sorted((n for n in histogram if n <= capacity * small), reverse=True):
        first, left = 0, histogram[n]
        while left:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                count = max(1, left // (capacity // n))
                open_by_gap[capacity].append((next_sequence, count))
                next_sequence += count
                gaps.append(capacity)
                continue
            gap = gaps[at]
            sequence, count = open_by_gap[gap].pop()
            take = min(count, left)
            if take < count:
                open_by_gap[gap].append((sequence + take, count - take))
            if not open_by_gap[gap]:
                gaps.pop(at)
            ranges.append((n, first, first + take, sequence, capacity - gap))
            rest = gap - n
            if rest:
                if not open_by_gap[rest]:
                    bisect.insort(gaps, rest)
                open_by_gap[rest].append((sequence, take))
            first, left = first + take, left - take
    return ranges


def _fill(room: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
    """How many of each size fill the room best: a bounded knapsack over sizes, larger ones preferred in ties."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    used: list[tuple[int, np.ndarray]] = []
    for i, (s, c) in enumerate(zip(sizes, counts)):
        most = min(c, room // s)
        if most < 1:
            continue
        before, taken = reach.copy(), np.zeros(room + 1, np.int16)
        for k in range(1, most + 1):
            fresh = np.zeros(room + 1, bool)
            fresh[k * s :] = before[: room + 1 - k * s]
            fresh &= ~reach
            reach |= fresh
            taken[fresh] = k
        used.append((i, taken))
    at, out = int(np.flatnonzero(reach)[-1]), {}
    for i, taken in reversed(used):
        k = int(taken[at])
        if k:
            out[i] = k
            at -= k * sizes[i]
    return out


def _take(runs: list[list[int]], count: int) -> list[tuple[int, int, int]]:
    """The next ``count`` pieces of a group."""
    out = []
    while count:
        run = runs[0]
        k = min(count, run[2])
        out.append((run[0], run[1], k))
        run[1], run[2], count = run[1] + k, run[2] - k, count - k
        if not run[2]:
            runs.pop(0)
    return out


def _at(runs: list[tuple[int, int, int]], place: int) -> tuple[int, int]:
    for n, first, count in runs:
        if place < count:
            return n, first + place
        place -= count
    raise IndexError(place)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece, and its ``ids`` on demand."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        ids, number = Ids(tokenizer_path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in slices(batches, limit=8 << 20):
            flat, bounds = ids.of(batch.column("text"))
            size = np.diff(bounds)
            count = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[owner] - start)
            begin = bounds[owner] + start
            check = np.fromiter((crc32(flat[a : a + n].astype("<u4").tobytes()) for a, n in zip(begin, length)), np.int64, len(owner))
            # The nth piece of its length in this partition.
            order = np.argsort(length, kind="stable")
            by = length[order]
            nth = np.empty(len(by), np.int64)
            nth[order] = np.arange(len(by)) - np.searchsorted(by, by, side="left")
            nth += number[length]
            number += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, check, nth)), pa.array(np.full(len(owner), part), pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"]
            if with_ids:
                columns.append(pa.array([flat[a : a + n].astype(np.int32) for a, n in zip(begin, length)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int" + ", ids array<int>" * with_ids
    held = Staged(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema), "pieces").df
    counted = held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = plan(histogram, capacity)
    table = pa.table([pa.array(c, pa.int64()) for c in (zip(*ranges) if ranges else [[]] * 5)], names=["length", "first", "after", "sequence", "offset"])
    # At most a few rows for each length a piece can have, whatever the number of pieces.
    places = F.broadcast(docs.sparkSession.createDataFrame(table))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = held.join(starts, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    placed = numbered.join(places, "length").where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("after")))
    out = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    return placed.select(*out, (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
