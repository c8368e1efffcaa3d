"""Vector codes against plain Python integers, and the exactness of limb products."""

import hashlib
import math
import random

import numpy as np
import pytest

from rowferry.llm import vector_codes as vc


def plain(rows, parts=8, entries=16, rounds=6):
    """The definition, one number at a time."""
    live = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not live:
        return {}
    length = len(live[0][1]) // parts
    cut = lambda v, p: v[p * length : (p + 1) * length]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    named = {}
    for i, v, _ in live:
        if i is not None:
            named[i] = min(named.get(i, v), v)
    books = [[cut(named[i], p) for i in sorted(named)[:entries]] for p in range(parts)]
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in live:
                groups.setdefault(near(v, p), []).append(cut(v, p))
            for e, got in groups.items():
                books[p][e] = [sum(c) // len(got) for c in zip(*got)]
    out = []
    for i, v, label in live:
        code = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code)), label))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    total = {}
    for _, _, error, label in out:
        total[label] = total.get(label, 0) + error
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def rows_of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


def test_whole_table_matches_plain_integers(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert rows_of(vc.compress(table)) == plain([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])


def test_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, -0.0001, 0.0, 0.25, 1e-9, 3.0]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[3], rows[3], (3, [9.0] * 16, 1), (None, [1.0] * 16, None), (61, None, 1), (62, [], 1), (63, [None] + [1.0] * 15, 2), (64, [float("nan")] + [1.0] * 15, 2), (65, [float("-inf")] + [1.0] * 15, None)]
    df = frame(spark, rows).selectExpr("*", "1 as code", "'x' as vector", "2 as of_label", "3 as error")
    assert rows_of(vc.compress(df)) == plain(rows)
    # A vector of another length than most takes no part.
    assert rows_of(vc.compress(frame(spark, rows + [(-1, [1.0] * 8, 1)]))) == plain(rows)


def test_few_vectors_and_none(spark):
    rows = [(2, [0.5] * 8, None), (1, [-0.5] * 8, None)]
    assert rows_of(vc.compress(frame(spark, rows))) == plain(rows)
    assert vc.compress(frame(spark, [])).collect() == []
    assert vc.compress(frame(spark, [(1, None, 1)])).collect() == []


def test_limb_products_are_exact_where_doubles_are_not():
    rng = np.random.default_rng(3)
    for bits in (5, 19, 20, 21, 27):
        x, y = (rng.integers(-(1 << bits), 1 << bits, (50, 8)) for _ in range(2))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x]
        assert vc.dots(x, y).tolist() == want
    code, far = vc.nearest_entries(np.array([[1, 1], [5, 5]]), np.array([[0, 0], [2, 2], [0, 0]]))
    assert code.tolist() == [0, 1] and far.tolist() == [2, 18]


def test_too_large_components_and_uneven_parts_are_errors(spark):
    with pytest.raises(ValueError, match="too large"):
        vc.whole_numbers(np.array([1e12] * 8), 8)
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(frame(spark, [(1, [1.0] * 9, 1)]))
