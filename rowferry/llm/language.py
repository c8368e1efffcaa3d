"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows in Spark tasks; the
matrix of log probabilities (``2**bits`` rows, one column per language) is
broadcast, and tasks score whole texts with numpy.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows with
a null ``lang`` are never learned from. Ties go to the language that sorts
first. Repeated rows are scored each. With no labelled row every text is
``und``. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowferry.llm.text import held_out, share, slices

ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letters: np.ndarray | None = None


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # (2**bits + 1, languages); the last row is the empty gram, zeros
    prior: np.ndarray
    bits: int


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, bool)
        for c in range(0x110000):
            _letters[c] = chr(c).isalpha()
    return _letters


def grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams at every place of every text, ``(n orders, places)``, and the text's bounds.

    Runs of anything but letters count as spaces; grams never cross texts and places without a gram hold ``2**bits``.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter_table()[points], points, np.uint32(32))
    offsets = np.concatenate([[0], ends])
    owner_end = np.repeat(ends, np.diff(offsets))
    place = np.arange(len(points))
    out = np.empty((len(ORDERS), len(points)), np.int32)
    shift, empty = np.uint32(32 - bits), 1 << bits
    for k, n in enumerate(ORDERS):
        h = np.full(len(points), n * 97, np.uint32)
        for i in range(n):
            h[: len(points) - i] = (h[: len(points) - i] ^ points[i:]) * _MIX[i]
        h ^= h >> np.uint32(15)
        out[k] = np.where(place + n <= owner_end, ((h * _MIX[0]) >> shift).astype(np.int32), empty)
        if n == 1:
            out[k][points == 32] = empty
    return out, offsets


def fit_language(docs: DataFrame, per_language: int = 3000, bits: int = 17, smoothing: float = 0.1) -> LanguageModel:
    """Learn from about ``per_language`` rows of each language that are not held out (all of them where there are fewer).

    The rows are a repeatable sample by id, so the cost of fitting does not grow with the input.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 0)
    rate = F.create_map(*[F.lit(x) for c in languages for x in (c, min(1.0, per_language / sizes[c]))])[F.col("lang")]
    index = {c: i for i, c in enumerate(languages)}

    def count(batches):
        total = {}
        for batch in slices(batches):
            found, offsets = grams(batch.column("text"), bits)
            for i, language in enumerate(batch.column("lang").to_pylist()):
                part = found[:, offsets[i] : offsets[i + 1]].ravel()
                total.setdefault(language, np.zeros((1 << bits) + 1, np.int64))
                total[language] += np.bincount(part, minlength=(1 << bits) + 1)
        for language, n in total.items():
            at = np.flatnonzero(n[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([index[language]] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["language", "gram", "n"])

    sample = rows.where(share(F.col("doc_id"), rate))
    counted = sample.mapInArrow(count, "language int, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    table = np.zeros(((1 << bits) + 1, len(languages)))
    table[got.column("gram").to_numpy(), got.column("language").to_numpy()] = got.column("n").to_numpy()
    table[:-1] += smoothing
    logs = np.zeros(table.shape, np.float32)
    logs[:-1] = np.log(table[:-1] / table[:-1].sum(axis=0))
    counts = np.array([sizes[c] for c in languages], float)
    return LanguageModel(languages, logs, np.log(counts / counts.sum()), bits)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, score being the posterior of the prediction."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in slices(batches, limit=1 << 20):
            n = batch.num_rows
            best, sure = np.zeros(n, np.int64), np.zeros(n)
            if m.languages:
                found, offsets = grams(batch.column("text"), m.bits)
                total = np.tile(m.prior, (n, 1))
                full = np.flatnonzero(np.diff(offsets))
                for row in found:
                    if len(row):
                        total[full] += np.add.reduceat(m.log_probability[row], offsets[:-1][full], axis=0, dtype=np.float64)
                best = total.argmax(axis=1)
                total -= total.max(axis=1, keepdims=True)
                sure = 1 / np.exp(total).sum(axis=1)
            names = [m.languages[i] if m.languages and ok else UNKNOWN for i, ok in zip(best, batch.column("has_letter").to_pylist())]
            sure = np.where([x != UNKNOWN for x in names], sure, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
