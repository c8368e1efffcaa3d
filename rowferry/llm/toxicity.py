"""Toxic spans by a linear-chain CRF: words tagged from labelled tokens, marginals gathered to a document's score.

Labelled tokens are derived from document labels: among the training rows, the
fewest words and beginnings of words that explain the toxic documents, and
hardly occur in others, are toxic; the CRF learns those tags from spelling and
neighbours.
Only ``text`` is ever scored.

Nulls: a null or empty text scores 0. Rows without label are not learned from;
repeated labels of a document count as the highest. Repeated rows are scored
each. Without any toxic label every score is 0. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowferry.llm import crf
from rowferry.llm.text import Words, held_out, share, slices, words_of

LABELS = ("clean", "toxic")
THRESHOLD = 0.3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}|*$%&#"


def features(word: str) -> tuple[list[str], list[str]]:
    w = word.strip(_EDGE).lower()
    own = ["b", "w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "6" + w[:6], "7" + w[:7], "8" + w[:8], "s" + w[-3:]]
    return own, ["w" + w]


def _beginnings(word: str) -> list[str]:
    """The word and its beginnings of each length, apart by a leading mark."""
    w = word.strip(_EDGE).lower()
    return ["=" + w, *(w[:n] for n in (4, 5, 6, 7, 8) if len(w) > n)]


def toxic_units(words: Words, toxic: np.ndarray, texts: np.ndarray, chance: float = 0.002, sure: float = 1e-5, precision: float = 0.9) -> set[str]:
    """The words and beginnings that explain the toxic documents.

    A candidate occurs, to ``precision``, in toxic documents only, and in more of them than ``chance`` explains. It is
    taken where it does so, by the stricter chance ``sure``, behind that many different words: what near copies share
    stands behind the same one. Then the candidate that most documents not yet explained share is taken, again and
    again. ``texts`` tells equal texts apart from others; copies of one count once.
    """
    first = np.zeros(len(toxic), bool)
    first[np.unique(texts, return_index=True)[1]] = True
    least = np.log(chance) / np.log(min(0.9, max(toxic[first].mean(), 1e-3)))
    names: dict[str, int] = {}
    units = [[names.setdefault(u, len(names)) for u in _beginnings(w)] for w in words.vocabulary]
    width = max((len(u) for u in units), default=0)
    table = np.full((len(units), width), -1, np.int64)
    for i, u in enumerate(units):
        table[i, : len(u)] = u
    rows, seen, bad, places = words.rows, np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), []
    live = first[rows]
    before = np.concatenate([[-1], words.codes[:-1]]) + 1
    before[words.offsets[:-1][np.diff(words.offsets) > 0]] = 0
    settings = np.zeros(len(names), np.int64)
    # A word's units of one length are unlike those of another, so each length is counted by itself.
    for column in table.T:
        unit = column[words.codes]
        kept = (unit >= 0) & live
        found = np.unique(rows[kept] * len(names) + unit[kept])
        row, unit = found // len(names), found % len(names)
        seen += np.bincount(unit, minlength=len(names))
        bad += np.bincount(unit[toxic[row]], minlength=len(names))
        places.append(found[toxic[row]])
        unit = column[words.codes]
        kept = (unit >= 0) & live & toxic[rows]
        settings += np.bincount(np.unique(unit[kept] * (len(units) + 1) + before[kept]) // (len(units) + 1), minlength=len(names))
    good = (bad >= least) & (bad >= precision * seen)
    found = np.concatenate([*places, np.zeros(0, np.int64)])
    found = found[good[found % max(len(names), 1)]] if len(names) else found
    row, unit = found // max(len(names), 1), found % max(len(names), 1)
    strict = least * np.log(sure) / np.log(chance)
    chosen = np.flatnonzero(good & (bad >= strict) & (settings >= strict)).tolist()
    open_ = np.ones(len(toxic), bool)
    open_[row[np.isin(unit, chosen)]] = False
    while len(unit):
        gain = np.bincount(unit[open_[row]], minlength=len(names))
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        open_[row[unit == best]] = False
    by_number = list(names)
    return {by_number[i] for i in chosen}


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1200, clean_rows: int = 1800, longest: int = 20_000) -> crf.Crf | None:
    """Learn from about so many toxic and clean labelled rows that are not held out, of at most ``longest`` characters.

    The rows are a repeatable sample by id, so fitting costs the same for any input. None where no row is toxic.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"] > 0: r["n"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(True):
        return None
    rate = F.when(F.col("toxic") > 0, min(1.0, toxic_rows / sizes[True])).otherwise(min(1.0, clean_rows / sizes.get(False, 1)))
    # The sample has a few thousand rows at any input, whatever table it is joined to.
    picked = F.broadcast(marks.where(share(F.col("doc_id"), rate, 23)))
    rows = docs.where(F.length("text") <= longest).select("doc_id", "text").join(picked, "doc_id").select("text", "toxic").toArrow()
    texts, toxic = rows.column("text").combine_chunks(), rows.column("toxic").to_numpy() > 0
    if not toxic.any():
        return None
    words = words_of(texts)
    bad = toxic_units(words, toxic, np.array([hash(t) for t in texts.to_pylist()]))
    named = np.array([any(u in bad for u in _beginnings(w)) for w in words.vocabulary], bool)
    gold = (named[words.codes] & toxic[words.rows]).astype(np.int64)
    return crf.train(LABELS, features, words.vocabulary, words.codes, words.offsets, gold, rounds=25)


def score_texts(scores: crf.WordScores, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """A score per text, the marginal of ``toxic`` per word, and the words."""
    words = words_of(texts)
    p = crf.marginals(scores.model, scores.emissions(words.vocabulary, words.codes, words.offsets), words.offsets)[:, 1] if len(words.codes) else np.zeros(0)
    out, rows = np.zeros(len(words.offsets) - 1), words.rows
    np.maximum.at(out, rows, p)
    sure = p >= 0.1
    clear = np.bincount(rows[sure], np.log1p(-np.minimum(p[sure].astype(np.float64), 1 - 1e-9)), len(out))
    return np.maximum(out, 1 - np.exp(clear)), p, words


def score_toxicity(docs: DataFrame, model: crf.Crf | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``: spans are ``start:end`` in code points of words likelier toxic than not, neighbours merged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spans(text: str, p: np.ndarray) -> str:
        found: list[list[int]] = []
        last = -2
        hot = p > 0.5
        for i, m in enumerate(WORD.finditer(text)):
            if hot[i]:
                if last == i - 1 and found:
                    found[-1][1] = m.end()
                else:
                    found.append([m.start(), m.end()])
                last = i
        return ",".join(f"{a}:{b}" for a, b in found)

    def run(batches):
        scores = crf.WordScores(shared.value, features) if shared.value else None
        for batch in slices(batches):
            n, texts = batch.num_rows, batch.column("text")
            total, where = np.zeros(n), [""] * n
            if scores:
                total, p, words = score_texts(scores, texts)
                total = np.clip(total, 0, 1)
                for i in np.unique(words.rows[p > 0.5]):
                    where[i] = spans(texts[i].as_py(), p[words.offsets[i] : words.offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(total, pa.float64()), pa.array((total >= threshold).astype(np.int32)), pa.array(where, pa.string())], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")
