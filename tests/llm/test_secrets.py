"""The secret scanner against plain code over the whole table, and the tagger on forms that no pattern covers."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from rowferry.llm import secrets

ALNUM = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
FORMS = {"passphrase": "passphrase={}", "bearer": "Bearer {}", "prefix": "ghp_{}", "auth": "auth: {}", "private": "private_key={}", "letters": "{}"}


@pytest.fixture(scope="module")
def many(spark, sf):
    return spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def model(many):
    return secrets.fit_secrets(many)


def plain(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]


def test_base_spans_of_the_whole_table(many, model):
    texts = {r.doc_id: r.text or "" for r in many.collect()}
    rows = secrets.scan_secrets(many, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        kinds = Counter(x.split(":")[0] for x in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_forms_that_no_pattern_covers_are_found(spark, many, model):
    rng = np.random.default_rng(99)
    quiet = [r.text.split(" ") for r in many.where("n_chars between 1500 and 6000").orderBy("doc_id").limit(40).collect() if not plain(r.text)]
    rows, planted = [], {}
    for name, form in FORMS.items():
        for n in range(30):
            value, words = "".join(rng.choice(ALNUM[:52] if name == "letters" else ALNUM, 32)), quiet[n % len(quiet)]
            at = int(rng.integers(0, min(200, len(words))))
            planted[len(rows)] = (name, value)
            rows.append((len(rows), " ".join([*words[:at], form.format(value), *words[at:]])))
    hit, other = Counter(), 0
    texts = dict(rows)
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        name, value = planted[r.doc_id]
        spans = [texts[r.doc_id][int(a) : int(b)] for _, a, b in (x.split(":") for x in filter(None, r.spans.split(",")))]
        hit[name] += any(value in s for s in spans)
        other += sum(value not in s for s in spans)
    assert min(hit[n] for n in FORMS) >= 24, hit
    assert other <= len(rows) // 20


def test_clean_texts_stay_mostly_untouched(many, model):
    added = [x for r in secrets.scan_secrets(many, model).collect() for x in r.spans.split(",") if x.startswith("crf:")]
    assert len(added) <= many.count() // 100


def test_the_driver_gets_nothing_but_the_model(spark, monkeypatch):
    """Windows and training stay in a task: the driver's memory does not hold them."""
    rows = [(i, f"some words of text number {i} and password=hunter{i}Zx9 then more words") for i in range(20)] + [(100 + i, f"only plain words of a quiet text and no more {i}") for i in range(20)]

    def no(*_, **__):
        raise AssertionError("in the driver")

    monkeypatch.setattr(secrets.crf, "train", no)
    monkeypatch.setattr(secrets, "transplants", no)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.fit_secrets(df, quiet_every=1)
    assert model.labels == secrets.LABELS and model.weights.any()
    assert secrets.fit_secrets(df.where("doc_id >= 100"), quiet_every=1) is None


def test_added_spans_are_swept_past_those_taken():
    taken = [(0, 0, 10), (2, 1, 4), (30, 2, 60)]
    assert secrets._apart([(5, 3, 8), (10, 3, 12), (25, 3, 30), (29, 3, 31), (59, 3, 70), (60, 3, 65)], taken) == [(10, 3, 12), (25, 3, 30), (60, 3, 65)]


def test_transplants_need_values_and_quiet_text():
    assert secrets.transplants([["password=abc123def"]], [], 5) == [] == secrets.transplants([["nothing", "here"]], [["a"]], 5)
    made = secrets.transplants([["password=abc123def"]], [["plain", "words"]], 5)
    assert len(made) == 5 and all(g.sum() == 1 and len(w) == len(g) for w, g in made)
    assert [w for w, _ in made] == [w for w, _ in secrets.transplants([["password=abc123def"]], [["plain", "words"]], 5)]
