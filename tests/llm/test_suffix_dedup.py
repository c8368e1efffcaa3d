"""Removal of long repeats against counting every 400-byte string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rowferry.llm import suffix_dedup as sd


def plain(texts, length=400):
    rows = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in rows for i in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 as key", "'s' as same", "2 as runs", "3 as n")
    assert rows_of(sd.remove_repeats(df)) == sorted(((i, *r) for i, r in zip(ids, plain(texts))), key=repr)


def prose(rng, n, words=("alpha", "bet", "gamma", "é", "漢字", "delta", "to", "x")):
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    passage, footer = prose(rng, 90), prose(rng, 70)
    out = [prose(rng, rng.randrange(300)) + rng.choice(["", " " + passage, passage[: rng.randrange(300, 600)]]) + prose(rng, rng.randrange(200)) + rng.choice(["", footer]) for _ in range(40)]
    whole = prose(rng, 150)
    out += [whole, whole, whole + " ", whole[5:], None, "", "short", "short", passage * 3, "a" * 700, "b" * 399 + "a" * 400, "ab" * 500 + whole, "\0" * 450 + "end"]
    for _ in range(12):  # near copies
        w = whole.split(" ")
        w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    return out


def test_shared_passages_copies_and_periods(spark, texts):
    check(spark, texts)


def test_hot_anchors_take_the_other_way(spark, texts, monkeypatch):
    """Groups beyond ``HOT`` give the same rows: pieces, kinds of pieces, and single windows."""
    monkeypatch.setattr(sd, "HOT", 3)
    check(spark, texts)


def test_small_slices_and_batches_lose_nothing(spark, texts, monkeypatch):
    anchor, second = (sd.Rolling(x) for x in sd._ODD)
    data, offsets = (np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8), np.cumsum([0] + [len((t or "").encode()) for t in texts]))
    windows = lambda got: {(d, i) for d, lo, hi in zip(got[0].tolist(), got[3].tolist(), got[4].tolist()) for i in range(lo, hi + 1)}
    one = windows(sd.runs_of(data, offsets, anchor, second))
    monkeypatch.setattr(sd, "SLICE", 997)
    many = sd.runs_of(data, offsets, anchor, second)
    assert one <= windows(many)  # periodic stretches keep one window of each kind for each slice
    assert all(0 <= lo <= at and at + sd.ANCHOR <= lo + sd.LENGTH + (hi - lo) for at, lo, hi in zip(*(x.tolist() for x in many[2:5])))


def test_repeated_and_null_ids(spark, texts):
    check(spark, [*texts[:6], *texts[:3], texts[40], texts[41]], [1, 1, 2, 2, None, None, 1, None, 7, 7, 7])


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = awkward.collect()
    long_one = next(r.text for r in rows if r.doc_id == 6)
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, plain([None if r.doc_id == 6 else r.text for r in rows])) if r.doc_id != 6), key=repr)
    # The very long text repeats itself from start to end.
    want.append((6, len(long_one), len(long_one), 1, hashlib.sha256(b"").hexdigest()))
    assert rows_of(sd.remove_repeats(awkward)) == sorted(want, key=repr)
    assert sd.remove_repeats(nothing).collect() == []


def test_columns_against_all_pairs():
    rng = random.Random(2)
    for _ in range(20):
        group = np.sort(np.array([rng.randrange(4) for _ in range(12)]))
        first = np.array([-rng.randrange(30) for _ in group])
        core = {g: bytes(rng.randrange(2) for _ in range(460)) for g in range(4)}
        rows = []
        for g, f in zip(group, first):
            b = bytearray(core[g][30 + f : 30 + f + 400 + rng.randrange(20)])
            if rng.random() < 0.5:
                b[rng.randrange(len(b))] ^= 1
            rows.append(bytes(b))
        size = np.array([len(r) for r in rows])
        got = sd.repeated_starts(group, first, size, np.frombuffer(b"".join(rows), np.uint8))
        seen = Counter((g, f + k, r[k : k + 400]) for g, f, r in zip(group, first, rows) for k in range(len(r) - 399))
        want = np.zeros_like(got)
        for i, (g, f, r) in enumerate(zip(group, first, rows)):
            for k in range(len(r) - 399):
                want[i, k] = seen[g, f + k, r[k : k + 400]] > 1
        assert (got == want).all()
