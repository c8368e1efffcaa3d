"""Similarity, neighbours, links, licences, URLs and packing against brute force on small fixtures."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rowferry.llm import components, licenses, neighbours, ngram_join, packing, urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_random_edges_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(None, 3), (7, 7)]
    want = Sets()
    for a, b in edges:
        if a is not None and a != b:
            want.join(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want.find(n) for n in want.up}


def shingles(text, size=3):
    words = (text or "").split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


@pytest.mark.parametrize("percent", [90, 60])
def test_similarity_components_equal_brute_force(spark, percent):
    """Copies with a few edits, at and around the bound, in groups larger than a block and a light shingle's limit."""
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 40, 60]))]
        for _ in range(rng.choice([1, 3, 20])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one", "one", "one two", "", " ", None, "one two three"])]
    sets = {i: shingles(t) for i, t in rows}
    want, links = Sets(), defaultdict(int)
    for a in sets:
        want.find(a)
        for b in sets:
            common = len(sets[a] & sets[b])
            if a != b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                want.join(a, b)
                links[a] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = ngram_join.BLOCK, ngram_join.LIGHT, ngram_join.DENSE
    for block, light, dense in ((1024, 128, 40), (8, 4, 3)):
        ngram_join.BLOCK, ngram_join.LIGHT, ngram_join.DENSE = block, light, dense
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.similar_components(df, percent).collect()}
        finally:
            ngram_join.BLOCK, ngram_join.LIGHT, ngram_join.DENSE = was
        assert got == {i: (len(s), want.find(i), links[i]) for i, s in sets.items()}


def test_similarity_of_awkward_rows(awkward, nothing):
    got = ngram_join.similar_components(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 3 and by[3]["n_shingles"] == 0
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert ngram_join.similar_components(nothing).count() == 0


def test_an_id_of_two_texts_ties_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, "x y z")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_bitmap_bound_never_excludes_a_match():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        other = base.copy()
        k = int(rng.integers(0, max(1, n // 10) + 1))
        other[:k] = rng.integers(0, 2**63, k).astype(np.uint64)
        other = np.concatenate([other, rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])
        x, y = np.unique(base), np.unique(other)
        common = len(np.intersect1d(x, y))
        flat, offsets = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
        maps = [(len(s), 8 * len(m), int.from_bytes(m, "little")) for s, m in zip((x, y), ngram_join.bitmaps(flat, offsets))]
        if 190 * common >= 90 * (len(x) + len(y)):
            assert ngram_join.may_match(*maps, 90)


def test_neighbours_equal_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[50:90] = v[10]  # one common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [None] * 12), (None, v[0].tolist()), (304, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    for tile, query_tile in ((8192, 1024), (37, 11)):
        got = defaultdict(list)
        for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, tile=tile, query_tile=query_tile).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 300, 10))
        for q in got:
            d = sorted((float(np.sqrt(np.square(v[q].astype(float) - v[c].astype(float)).cumsum()[-1])), c) for c in range(300) if c != q)[:10]
            assert [(r, c) for r, c, _ in got[q]] == [(i + 1, c) for i, (_, c) in enumerate(d)]
            assert np.allclose([s for *_, s in got[q]], [s for s, _ in d], rtol=1e-12)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3


def test_neighbours_in_many_partitions(spark):
    """Both sides of a pair of tiles meet, in whatever partitions they are dealt out to."""
    v = np.random.default_rng(7).normal(size=(400, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    told = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        for tile, query_tile in ((8192, 1024), (90, 15)):
            got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, tile=tile, query_tile=query_tile).collect()}
            d = np.sqrt(np.square(v[::10, None].astype(float) - v[None].astype(float)).sum(axis=2))
            d[np.arange(40), np.arange(0, 400, 10)] = np.inf
            assert got == {(10 * q, r + 1): c for q in range(40) for r, c in enumerate(np.argsort(d[q], kind="stable")[:10])}
    finally:
        for k, x in told.items():
            spark.conf.set(k, x)


def test_neighbours_beyond_the_range_of_squares(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 1.0]), (2, [1e200, 1.0]), (3, [3.0, 4.0]), (4, [5e-324, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 2, 1.0), (0, 1, float("inf")), (0, 3, float("inf")), (3, 4, 5.0), (3, 0, float("inf")), (3, 1, float("inf"))]


def test_licences(spark, awkward, nothing):
    texts = {
        1: "Released under the MIT License. Also: the  Apache\nLicense, Version 2.0!",
        2: "licensed under the GNU General Public License, version 3 or later, and mit-license",
        3: "SPDX-License-Identifier: GPL-2.0-only",
        4: "Licensed under CC BY-NC 4.0.",
        5: "the general public, a license",
        6: "MIT License " * 3,
    }
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"]) == (2, 3, 7, "apache,mit", "apache,apache-2.0,mit")
    assert (got[2]["base_labels"], got[2]["labels"]) == ("gpl,mit", "gpl,gpl-3.0-or-later,mit")
    assert (got[3]["n_base"], got[3]["labels"], got[3]["score"]) == (0, "gpl-2.0", 1.0)
    assert got[4]["labels"] == "cc-by-nc-4.0" and got[5]["labels"] == "" and got[5]["n_base"] == 0
    assert (got[6]["n_base"], got[6]["n_words"], got[6]["last_word"]) == (3, 6, 4)
    assert len(licenses.rules()) > 200
    some = licenses.scan_licenses(awkward)
    assert some.count() == awkward.count() and some.where("doc_id in (3, 4, 5) and n_words = 0 and labels = '' and score = 0").count() == 3
    assert licenses.scan_licenses(nothing).count() == 0


def test_urls(spark):
    link = '<html><head><link href="{}" rel="canonical"></head></html>'
    rows = [
        (1, "http://a.net/en/1", link.format("https://shop.com/de/x")),  # tied to a blocked one
        (2, "http://b.net/z", '<meta http-equiv="refresh" content="0; url=http://a.net/en/1/">'),  # through another
        (3, "HTTP://X.COM/de/y?q#f", link.format("/fr/z")),  # its own rule says block
        (4, "https://c.net/p", link.format("http://x.com/de/q")),
        (5, "http://www.c.net/p/#top", link.format("http://y.com/fr/ok")),  # an allowed alias wins
        (6, "http://example.org/es/1", None),
        (7, "http://m.example.org/en/12", ""),
        (8, "http://example.org", ""),
        (9, None, None),
        (10, "no scheme", link.format("http://shop.com/de/x")),
        (1, "http://a.net/en/1", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as verdict", "2 as root", "3 as group")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()}
    assert got[1] == ("a.net", "/en/1", None, "block") and got[2][3] == "block"
    assert got[3] == ("x.com", "/de/y", "com/de/", "block")
    assert got[4][3] == got[5][3] == "allow"
    assert got[6][2:] == ("example.org/es/", "block") and got[7][2:] == ("example.org/en/1", "block")
    assert got[8] == ("example.org", "", None, "allow")
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert urls.judge_urls(df).count() == len(rows) and urls.judge_urls(df.limit(0)).count() == 0


def test_ids_equal_the_tokenizers_own():
    full, ids, rng = Tokenizer.from_file(TOKENIZER), packing.Ids(TOKENIZER), random.Random(9)
    alphabet = "abcXYZ éÉßÿÀ×÷ 019.,;:!?'s \t\n\x0b\x1c　́İΣςK漢\U0001f600<|endoftext|>-_`ªº"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)] + ["<|startoftext|> x", "ΑΣ ΑΣ.", ""]
    flat, bounds = ids.of(pa.array(texts))
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == full.encode(t, add_special_tokens=False).ids + [1], repr(t)


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_of_awkward_rows_and_the_table(docs, awkward, nothing):
    full = Tokenizer.from_file(TOKENIZER)
    for df, capacity in ((awkward, 4096), (docs, 4096), (docs, 512)):
        rows = packing.pack(df, TOKENIZER, capacity).collect()
        used, total = check_packed(rows, capacity), sum(r["length"] for r in rows)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = np.array(full.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(repr(r["doc_id"]), k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
        assert sorted(want) == sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        assert used <= 1.05 * -(-total // capacity) + 1
    assert packing.pack(nothing, TOKENIZER).count() == 0
    kept = packing.pack(docs.limit(20), TOKENIZER, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in kept)


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_of_a_plan_has_one_place(seed):
    rng = random.Random(seed)
    lengths = {rng.randrange(1, 101): rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(rng.randrange(1, 60))}
    ranges = packing.plan(lengths, 100)
    by = defaultdict(list)
    for n, first, after, *_ in ranges:
        by[n].append((first, after))
    for n, count in lengths.items():
        parts = sorted(by[n])
        assert parts[0][0] == 0 and parts[-1][1] == count and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    if sum(lengths.values()) < 5000:
        rows = [{"length": n, "sequence_id": s + r - first, "offset": o} for n, first, after, s, o in ranges for r in range(first, after)]
        check_packed(rows, 100)


def test_pipeline_stages_pass_on_what_they_keep(spark, sf, docs):
    columns, now = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf).cache()
        if k < 4:
            assert out.columns == columns, name
        if k in (0, 1):
            assert 0 < out.count() < now.count()
        if k == 2:
            assert out.count() == now.count() and out.where("text like '%AKIA%'").count() == 0
        now = out
    assert now.count() > 0


def test_pipeline_drops_copies_with_isolated_edits(spark, sf):
    """One word in fifty replaced: under the bound of op8's query, over the stage's."""
    a = [f"w{i}" for i in range(1000)]
    b = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(a)]
    far = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(a)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(far))], "doc_id long, text string")
    assert ngram_join.keep_one(df).count() == 3
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert sorted(r["doc_id"] for r in stage(spark, df, sf).collect()) == [1, 3]


@pytest.mark.parametrize("block", [1024, 4])
def test_repeated_ids_are_one_document(spark, monkeypatch, block):
    """Rows that repeat an id, with one text or several, next to near copies: each other id is counted once."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(3)]
    texts = []
    for _ in range(24):
        copy = list(rng.choice(base))
        copy[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(copy))
    rows = [(i, rng.choice(texts)) for i in range(10, 30)] + [(5, t) for t in texts[:8]] * 4 + [(40, texts[0])] * 30
    rows += [(rng.randrange(50, 54), t) for t in texts] + [(60, "alone in this table"), (60, "alone in this table"), (5, ""), (None, texts[0])]
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            sets[i].add(frozenset(shingles(t)))
    want, links = Sets(), defaultdict(int)
    for a in sets:
        want.find(a)
        for b in sets:
            if a != b and any(100 * len(x & y) >= 90 * len(x | y) for x in sets[a] for y in sets[b]):
                want.join(a, b)
                links[a] += 1
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got if r["n_shingles"] and r["doc_id"] is not None} == {(i, want.find(i), links[i]) for i in sets}


def test_an_id_with_very_many_rows_counts_once(spark):
    """Nearly all rows repeat one id and text beside a near copy."""
    a = [f"w{i}" for i in range(80)]
    b = " ".join(a[:-1] + ["x"])
    rows = [(1, " ".join(a))] * 3000 + [(2, b)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).distinct().collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_what_many_texts_share_stays_out_of_prefixes(size, percent):
    """Texts of other words that end alike have no prefix shingle of that end, so it ties none of them."""
    rng = np.random.default_rng(6)
    end = " ".join(f"end{i}" for i in range(60))
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 240)) + " " + end for _ in range(400)])
    flat, offsets = ngram_join.shingle_sets(texts, size)
    sums = np.bincount(flat & np.uint64(ngram_join.SUMS - 1), minlength=ngram_join.SUMS)
    low, ends = ngram_join.low_shingles(flat, offsets, percent)
    first, _ = ngram_join.prefixes(low, ends, np.diff(offsets), percent, sums)
    _, seen = np.unique(first, return_counts=True)
    assert (seen == 1).mean() > 0.99 and seen.max() <= 2
