"""Similarity join on word n-grams: exact Jaccard by blocked sparse products of the document by n-gram matrix.

1. Every text becomes the set of its hashed shingles; equal sets are one class, and a class's smallest id stands for it.
2. A pair that is similar enough must share one of the first ``n - ceil(t n) + 1`` shingles of each set, in any fixed
   order. The order begins with twice as many shingles as a prefix takes, by hash, and of these the rarer ones come
   first, so boilerplate makes few candidates. How often a shingle occurs is read from a table of sums of fixed size
   over all texts: where the corpus is large its sums are large too, but what many texts share still stands out.
   Sets that share a prefix shingle, at sizes that can match, are chained; chains make groups.
3. Within a group, cut into blocks of bounded size, products of incidence blocks count the overlap of all pairs at
   once. Pairs below the bound that their sizes set are dropped; what is left are the links.
4. Components of the links, back to all members of each class.

Hashes have 64 bits, those of whole sets 128. No pair is skipped and no group is capped.

Nulls: a null, empty or blank text has no shingles, links with nothing and is its own component. A null ``doc_id``
takes no part: its component is null. Rows that repeat an id are one document: their links are joined, and each other id
is counted once. From candidates on there is one row for each class, whatever its ids; ids of several different texts are
counted apart, which costs the square of how many of them are alike. The smallest id names a component. An empty table gives an empty result. Other columns are ignored.
``doc_id`` is an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rowferry.llm.components import connected_components
from rowferry.llm.text import slices, words_of
from rowferry.session import Staged, remove

_P = tuple(np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
# Rows of one block of the incidence matrix; a product takes two blocks at most.
BLOCK = 1024
# A shingle in more rows of a product than this is counted by a dense product, others pair by pair.
DENSE = 40
_SLAB = 4096
# Bytes of text whose shingles are hashed at once: a task then holds some tens of MB of them.
SLICE = 1 << 20
# Sums of how often shingles occur, by their low hash bits, and how many of them are sent as one row.
SUMS = 1 << 20
SUMS_ROW = 1 << 15
# Sets at one prefix shingle that are compared pair by pair for ties.
LIGHT = 128
# Shingles of all sets of a block, about; and of a product before it is taken.
BLOCK_SHINGLES = 500_000


def shingle_sets(texts: pa.Array, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and each text's bounds."""
    words = words_of(texts, lower=True)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words.vocabulary), np.uint64, len(words.vocabulary))
    count = np.diff(words.offsets)
    at = known[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            part = np.zeros(len(at), np.uint64)
            part[: len(at) - k] = at[k:] if k else at
            h = (h + part) * _P[k % 3]
            h ^= h >> np.uint64(31)
        short = np.flatnonzero((count > 0) & (count < size))
        for row in short:  # the whole sequence is the only shingle
            x = np.uint64(count[row])
            for w in at[words.offsets[row] : words.offsets[row + 1]]:
                x = (x + w) * _P[2]
                x ^= x >> np.uint64(29)
            h[words.offsets[row]] = x
    kept = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), kept)
    offsets = np.concatenate([[0], np.cumsum(kept)])
    flat = h[np.arange(len(owner)) - offsets[owner] + words.offsets[owner]]
    for a, b in zip(offsets[:-1], offsets[1:]):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(count)))]).astype(np.int64)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap that a set of ``n`` has with any similar one."""
    return (percent * n + 99) // 100


def low_limit(percent: int) -> np.uint64:
    """Hashes below this are low: twice the share that a prefix takes."""
    return np.uint64(min((1 << 64) - 1, (1 << 64) * 2 * (100 - percent) // 100))


def low_shingles(flat: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles from which each set's prefix is taken, by hash: all low ones, and more if those are too few."""
    size = np.diff(offsets)
    low = np.concatenate([[0], np.cumsum(flat < low_limit(percent))])
    take = np.maximum(prefix_size(size, percent), low[offsets[1:]] - low[offsets[:-1]])
    ends = np.concatenate([[0], np.cumsum(take)])
    return flat[np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], take)], ends


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - least_overlap(n, percent) + 1, 0)


def prefixes(low: np.ndarray, ends: np.ndarray, size: np.ndarray, percent: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the order: the low ones by how often they occur, then all others; by hash within each."""
    often = sums[(low & np.uint64(SUMS - 1)).astype(np.int64)].astype(np.int64)
    rank = np.where(low < low_limit(percent), often, np.iinfo(np.int64).max)
    owner = np.repeat(np.arange(len(size)), np.diff(ends))
    low = low[np.lexsort((low, rank, owner))]
    take = prefix_size(size, percent)
    out = np.concatenate([[0], np.cumsum(take)])
    return low[np.arange(out[-1]) + np.repeat(ends[:-1] - out[:-1], take)], out


def shingle_sums(sets: DataFrame) -> np.ndarray:
    """How often low shingles occur in all sets, added up by their low hash bits; two that meet in a sum share it.

    It only orders prefixes: any outcome gives the same links.
    """

    def add(batches):
        sums = np.zeros(SUMS, np.int64)
        for batch in batches:
            low = batch.column("low").flatten().to_numpy()
            sums += np.bincount(low & (SUMS - 1), minlength=SUMS)
        if sums.any():
            for row in range(0, SUMS, SUMS_ROW):
                yield pa.RecordBatch.from_pydict({"row": pa.array([row]), "sums": pa.array([sums[row : row + SUMS_ROW].tobytes()], pa.binary())})

    def gather(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist()):
                rows[row] = rows.get(row, 0) + np.frombuffer(data, np.int64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array([x.tobytes() for x in rows.values()], pa.binary())], ["row", "sums"])

    kind = "row long, sums binary"
    got = sets.select("low").mapInArrow(add, kind).repartition("row").mapInArrow(gather, kind).toArrow()
    out = np.zeros(SUMS, np.int64)
    for row, data in zip(got.column("row").to_pylist(), got.column("sums").to_pylist()):
        out[row : row + SUMS_ROW] = np.frombuffer(data, np.int64)
    return out


def bitmaps(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bit for each shingle by its low hash bits, in a map with a power of two of about as many bits as shingles."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        width = 1 << max(6, min(16, int(b - a - 1).bit_length()))
        bits = np.zeros(width, np.uint8)
        bits[(flat[a:b] & np.uint64(width - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def may_match(x: tuple[int, int, int], y: tuple[int, int, int], percent: int) -> bool:
    """Whether two sets, each as (size, map width, map), can overlap enough: a bit of one that the other lacks is a shingle it lacks."""
    (n, v, a), (m, w, b) = x, y
    while v > w:
        v >>= 1
        a = (a & ((1 << v) - 1)) | (a >> v)
    while w > v:
        w >>= 1
        b = (b & ((1 << w) - 1)) | (b >> w)
    most = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return (100 + percent) * most >= percent * (n + m)


def overlaps(rows: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """Overlap counts of all pairs of ``n`` sets given as (row, token) pairs: the product of the incidence matrix with its transpose."""
    order = np.lexsort((rows, tokens))
    rows, tokens = rows[order], tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(tokens)))
    out = np.zeros(n * n, np.float32)
    light = [np.zeros(0, np.int64)]
    held = 0
    for f in range(2, DENSE + 1):
        at = starts[count == f]
        if not len(at):
            continue
        table = rows[at[:, None] + np.arange(f)]
        i, j = np.triu_indices(f, 1)
        for part in np.array_split(table, max(1, len(table) * len(i) // 4_000_000)):
            light.append((part[:, i] * n + part[:, j]).ravel())
            held += len(light[-1])
            if held > 8_000_000:
                out += np.bincount(np.concatenate(light), minlength=n * n)
                light, held = [np.zeros(0, np.int64)], 0
    out += np.bincount(np.concatenate(light), minlength=n * n)
    out = out.reshape(n, n)
    heavy = np.flatnonzero(count > DENSE)
    for k in range(0, len(heavy), _SLAB):
        some = heavy[k : k + _SLAB]
        block = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), count[some])
        block[rows[np.repeat(starts[some], count[some]) + np.arange(len(column)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])], column] = 1
        out += np.triu(block @ block.T, 1)
    return out


def linked(overlap: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that reach the similarity; the bound follows from their two sizes."""
    at = np.flatnonzero(overlap)
    i, j = at // len(size), at % len(size)
    hit = (100 + percent) * overlap.ravel()[at].astype(np.int64) >= percent * (size[i] + size[j])
    return i[hit], j[hit]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def similar_components(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row; links count the other documents similar to it."""
    context = docs.sparkSession.sparkContext

    def lists(flat, ends):
        return pa.ListArray.from_arrays(ends.astype(np.int32), flat.view(np.int64))

    def sketch(batches):
        for batch in slices(batches, limit=SLICE):
            flat, offsets = shingle_sets(batch.column("text"), size)
            keys = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            low = lists(*low_shingles(flat, offsets, percent))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(offsets)), pa.array(keys, pa.binary()), low, pa.array(bitmaps(flat, offsets), pa.binary())], ["doc_id", "mark", "n", "key", "low", "map"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sketches = Staged(texts.mapInArrow(sketch, "doc_id long, mark long, n long, key binary, low array<long>, map binary"), "shingles")
    held = Staged(sketches.df.select("doc_id", "mark", "n", "key"), "sets").df
    sums = context.broadcast(shingle_sums(sketches.df))
    real = held.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # One row for each id and set; ids of several sets are told apart, as their links cannot be summed by class.
    paired = Staged(real.groupBy("doc_id", "key").agg(F.min("mark").alias("mark"), F.max("n").alias("n")), "pairs")
    pairs = paired.df
    several = Staged(pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("doc_id"), "several")
    several_ids = F.broadcast(several.df) if several.small else several.df
    told = pairs.join(several_ids.withColumn("many", F.lit(True)), "doc_id", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    classes = told.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min_by("mark", "doc_id").alias("mark"), F.min_by("many", "doc_id").alias("many"), F.max("n").alias("n"),
        F.count_if(~F.col("many")).alias("copies"), F.bit_xor(F.when(F.col("many"), F.xxhash64("doc_id"))).alias("crowd"),
    )
    # A node only makes groups: two classes at one node share a group, no more.
    classes = Staged(classes.withColumn("node", F.when(F.col("many"), F.xxhash64("key")).otherwise(F.col("rep"))).drop("many"), "classes").df
    named = Staged(pairs.join(several_ids, "doc_id").select("key", "doc_id"), "named").df
    for done in (paired, several):
        remove(docs.sparkSession, done.path)

    # Candidates: sets that share a prefix shingle.
    def first_ones(batches):
        for batch in batches:
            low = batch.column("low")
            ends = low.offsets.to_numpy().astype(np.int64)
            first = prefixes(low.flatten().to_numpy().view(np.uint64), ends - ends[0], batch.column("n").to_numpy(), percent, sums.value)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "n", "map")] + [lists(*first)], ["node", "n", "map", "prefix"])

    begun = sketches.df.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "map", "low"))).join(classes.select("key", "node"), "key").select("node", "n", "map", "low")
    begun = Staged(begun.mapInArrow(first_ones, "node long, n long, map binary, prefix array<long>"), "prefixes")
    remove(docs.sparkSession, sketches.path)
    reps = begun.df
    tokens = reps.select("node", "n", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen"), F.min("n").alias("least"), F.max("n").alias("most"))
    # Of two sets alone at a shingle the sizes already tell whether they can match.
    shared = shared.where((F.col("seen") > 2) | ((F.col("seen") == 2) & (100 * F.col("least") >= percent * F.col("most")))).select("token", "seen")
    met = Staged(tokens.join(shared, "token"), "places")
    places = met.df

    def tie(batches):
        parent: dict[int, int] = {}

        def find(i):
            while (p := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[p]
            return i

        def compare(group):
            group.sort()
            edges = []
            for i, x in enumerate(group):
                for y in group[i + 1 :]:
                    if 100 * x[0] < percent * y[0]:
                        break
                    a, b = find(x[3]), find(y[3])
                    if a != b and may_match(x[:3], y[:3], percent):
                        parent[max(a, b)] = min(a, b)
                        edges.append((x[3], y[3]))
            return edges

        group, last = [], None
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for token, node, n, m in zip(*(batch.column(c).to_pylist() for c in ("token", "node", "n", "map"))):
                if token != last:
                    edges += compare(group)
                    group, last = [], token
                group.append((n, 8 * len(m), int.from_bytes(m, "little"), node))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
        edges = compare(group)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    light = places.where(F.col("seen") <= LIGHT).select("token", "node").join(reps.select("node", "n", "map"), "node")
    light = light.repartition("token").sortWithinPartitions("token").mapInArrow(tie, "a long, b long")
    # At commoner shingles, sets whose sizes can match are chained: by size, and within a size to the smallest id.
    many = places.where(F.col("seen") > LIGHT)
    hubs = many.groupBy("token", "n").agg(F.min("node").alias("hub"))
    by_size = Window.partitionBy("token").orderBy("n")
    steps = hubs.select("n", "hub", F.lag("hub").over(by_size).alias("before"), F.lag("n").over(by_size).alias("smaller")).where(100 * F.col("smaller") >= percent * F.col("n"))
    chained = many.join(hubs, ["token", "n"]).select(F.col("node").alias("a"), F.col("hub").alias("b")).union(steps.select(F.col("hub").alias("a"), F.col("before").alias("b")))
    ties = light.union(chained)
    groups = connected_components(ties)
    sized = groups.join(classes, "node")
    members = sized.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = sized.join(members, "root").select(F.col("rep").alias("doc_id"), "mark", "key", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), "copies", "crowd")
    wanted = Staged(placed, "wanted")

    # Their sets again, each sent to the products of its block with every other block of the group.
    def resets(batches):
        sent = set()
        for batch in slices(batches, limit=SLICE):
            flat, offsets = shingle_sets(batch.column("text"), size)
            sets = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            fresh = []
            for row, (key, data) in enumerate(zip(batch.column("key").to_pylist(), sets)):
                if key not in sent and hashlib.blake2b(data, digest_size=16).digest() == key:
                    sent.add(key)
                    fresh.append(row)
            some = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "key", "root", "blocks", "block", "copies", "crowd")), pa.array([sets[r] for r in fresh], pa.binary())], ["id", "key", "root", "blocks", "block", "copies", "crowd", "set"])

    small = F.broadcast(wanted.df) if wanted.small else wanted.df
    chosen = texts.join(small, ["doc_id", "mark"]).select(F.col("doc_id").alias("id"), "key", "root", "blocks", "block", "copies", "crowd", "text")
    sets = chosen.mapInArrow(resets, "id long, key binary, root long, blocks int, block int, copies long, crowd long, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("*", other.alias("other")).select("id", "key", "copies", "crowd", "set", "block", "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def product(batches):
        rows: list[tuple] = []
        held_shingles, last = 0, None

        def flush():
            code: dict[tuple, int] = {}
            group = np.array([code.setdefault(r[0], len(code)) for r in rows], np.uint64)
            ids, copies, block = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            cross = np.array([r[0][1] != r[0][2] for r in rows])
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            n = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):  # a shingle of another group is another shingle
                tokens = np.concatenate(sets) ^ np.repeat((group + np.uint64(1)) * _P[0], n)
            i, j = linked(overlaps(np.repeat(np.arange(len(rows)), n), tokens, len(rows)), n, percent)
            fit = (group[i] == group[j]) & (~cross[i] | (block[i] != block[j]))
            i, j = i[fit], j[fit]
            label, weight = _roots(len(rows), i, j), np.zeros(len(rows), np.int64)
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            some = np.unique(np.concatenate([i, j]))
            # Which sets are similar to one that ids of several sets have, once for each such crowd.
            crowds: dict[int, int] = {}
            crowd = np.array([-1 if r[6] is None else crowds.setdefault(r[6], len(crowds)) for r in rows], np.int64)
            x, y = np.concatenate([i, j]), np.concatenate([j, i])
            met = np.unique(x[crowd[y] >= 0] * len(rows) + crowd[y[crowd[y] >= 0]])
            near, by = met // len(rows), list(crowds)
            at = np.concatenate([some, near])
            given = [pa.array([rows[r][5] for r in at], pa.binary()), pa.array(ids[at]), pa.array(ids[np.concatenate([label[some], near])])]
            count = pa.array(np.concatenate([weight[some], np.zeros(len(near), np.int64)]))
            return pa.RecordBatch.from_arrays([*given, count, pa.array([None] * len(some) + [by[c] for c in met % len(rows)], pa.int64())], ["key", "a", "b", "links", "crowd"])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["root"], r["lo"], r["hi"])
                if rows and key == last and r["key"] == rows[-1][5]:  # from another task
                    continue
                if rows and key != last and (len(rows) >= BLOCK // 2 or held_shingles >= BLOCK_SHINGLES):
                    yield flush()
                    rows, held_shingles = [], 0
                rows.append((key, r["id"], r["copies"], r["block"], r["set"], r["key"], r["crowd"]))
                held_shingles += len(r["set"]) // 8
                last = key
        if rows:
            yield flush()

    links = Staged(dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "key").mapInArrow(product, "key binary, a long, b long, links long, crowd long"), "links").df

    for done in (begun, met, wanted):
        remove(docs.sparkSession, done.path)

    # Components over class representatives; an id of several sets ties their classes.
    tied = named.join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(links.select("a", "b").union(tied))
    degree = links.groupBy("key").agg(F.sum("links").alias("links"))
    # The ids of several sets that each class has or is similar to, each once.
    crowds = named.join(classes.select("key", "crowd"), "key").select("crowd", F.col("doc_id").alias("other")).distinct()
    near = links.where(F.col("crowd").isNotNull()).select("key", "crowd").distinct().join(crowds, "crowd").select("key", "other")
    near = Staged(near.union(named.select("key", F.col("doc_id").alias("other"))).distinct(), "near").df
    known = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "key", "left").join(near.groupBy("key").agg(F.count(F.lit(1)).alias("others")), "key", "left")
    known = known.select("key", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("links"))
    single = near.join(classes.select("key", "copies"), "key").groupBy(F.col("other").alias("doc_id")).agg(F.sum("copies").alias("single"))
    other = named.join(near, "key").select("doc_id", "other").distinct().groupBy("doc_id").agg((F.count(F.lit(1)) - 1).alias("others"))
    own = Staged(single.join(other, "doc_id").select("doc_id", (F.col("single") + F.col("others")).alias("own")), "own")
    # Each key is met once by a plain join, whose hot keys (many copies of one text) are split as they are found.
    out = held.select("doc_id", "n", "key").join(known, "key", "left").join(F.broadcast(own.df) if own.small else own.df, "doc_id", "left")
    live = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(live, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"), F.when(live, F.coalesce("own", "links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """The rows but for those that a row with a smaller id stands for: one document of each component stays.

    Rows that repeat the id that stays are one document and all stay, as do rows with a null id and texts without
    shingles. Texts are not shuffled unless the ids to drop are too many to broadcast.
    """
    found = similar_components(docs, percent, size)
    losers = Staged(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__ngram_loser")).distinct(), "losers")
    small = F.broadcast(losers.df) if losers.small else losers.df
    return docs.join(small, F.col("doc_id").cast("long") == F.col("__ngram_loser"), "left_anti")
