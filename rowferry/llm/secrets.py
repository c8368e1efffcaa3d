"""Secrets in texts: fixed patterns, and spans that a linear-chain CRF tags begin / inside / outside, decoded by Viterbi.

The CRF learns from words that the patterns cover in a bounded sample of texts,
by shape, length, spread of characters, neighbouring words and what kind of
file the text is. Learnt like that it would only repeat the patterns, by their
key words. So the values found are also put into quiet texts, bare and under
words that are no keys, with their characters dealt anew, in other lengths and
of letters alone: what is left to learn from is what a secret looks like. Its
spans are added where they overlap no pattern's span; those always stay.

Nulls: a null text is an empty one, with no span. Repeated rows are scanned
each. Ties of spans at one start are ordered by kind: assign, access, hex, crf.
Without any example in the sample only the patterns are used. An empty table
gives an empty result. Other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowferry.llm import crf
from rowferry.llm.text import Words, share, slices, words_of

LABELS = ("outside", "begin", "inside")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WRAP = "\"'`.,;:()[]{}<>"
# Text without any of these holds no pattern.
_MAYBE = (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")
# Window of words kept around an example for learning.
WINDOW = 30

Span = tuple[int, int, int]  # start, kind, end


def pattern_spans(text: str, maybe: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    """The patterns' spans, by start and kind. Matches that are too short are dropped after they have taken their text."""
    found: list[Span] = []
    if maybe[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if maybe[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if maybe[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def candidates(texts: pa.Array) -> np.ndarray:
    """Which kinds each text may hold, ``(texts, kinds)``, by a linear-time scan."""
    return np.stack([pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in _MAYBE], axis=1)


def _shape(word: str) -> str:
    out, last, run = [], "", 0
    for c in word[:80]:
        kind = "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c if c < "\x80" else "u"
        if kind == last:
            run += 1
            if run in (2, 4, 8, 16):
                out.append("+")
        else:
            out.append(kind)
            last, run = kind, 1
    return "".join(out)


def features(word: str) -> tuple[list[str], list[str]]:
    """Own features and those seen by the neighbours."""
    w = word.strip(_WRAP)
    if w.isalpha() and (len(w) < 12 or not w.isascii()) and not (w.isascii() and w.isupper() and len(w) > 8):  # an ordinary word
        low = w.lower()
        kind = "p" if len(w) < 16 else "P"
        return ["b", kind, "k" + low[:10] if len(w) < 12 else kind], ["k" + low, kind]
    digits = sum(c.isdigit() for c in w)
    upper = sum("A" <= c <= "Z" for c in w)
    lower = sum("a" <= c <= "z" for c in w)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:]))
    size = min(len(w) // 4, 12)
    key = re.split(r"[:=]", w, maxsplit=1)
    value = key[-1].strip(_WRAP) or w
    spread = len(set(value)) * 8 // max(len(value), 1)
    hard = max(map(len, re.split(r"[^b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]", value)))  # the longest run of consonants
    mixed = sum(a.islower() and b.isupper() for a, b in zip(value, value[1:]))
    plain = max(map(len, re.split(r"[^A-Za-z0-9]", value)))  # the longest run of letters and digits
    shape = _shape(w)
    own = ["b", f"n{size}", f"d{digits * 4 // max(len(w), 1)}", f"m{digits > 0}{upper > 0}{lower > 0}{size > 3}", f"t{min(turns, 8)}{size > 3}", f"u{spread}{size > 3}", f"h{min(hard, 8)}{plain > 11}", f"x{min(mixed, 6)}{plain > 11}", f"l{min(plain // 4, 9)}{any(c.isdigit() for c in value)}", "S" + shape[:24], f"q{word[:1] in _WRAP}{word[-1:] in _WRAP}"]
    if len(key) > 1:
        own += ["K" + key[0].lower()[:16], f"v{min(len(key[1]) // 4, 8)}"]
    return own, ["S" + shape[:8], "k" + key[0].lower()[:16]]


def _file_kind(texts: pa.Array) -> np.ndarray:
    """What kind of file each text looks like: its share of digits and of marks used in code, in steps."""
    size = np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1)
    digits = pc.count_substring_regex(texts, "[0-9]").to_numpy(zero_copy_only=False) / size
    marks = pc.count_substring_regex(texts, "[={};:_]").to_numpy(zero_copy_only=False) / size
    return np.searchsorted([0.002, 0.01, 0.05, 0.2], digits) * 5 + np.searchsorted([0.002, 0.01, 0.05, 0.2], marks)


def _file_feature(kind: np.ndarray, bits: int) -> np.ndarray:
    return (kind.astype(np.int64) * 2654435761 + 97) % (1 << bits)


def _gold(text: str, spans: list[Span], n: int) -> np.ndarray:
    """Labels of the words that the spans cover."""
    out = np.zeros(n, np.int64)
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts, ends = np.array([a for a, _ in at]), np.array([b for _, b in at])
    for start, _, end in spans:
        i, j = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(starts, end, side="left"))
        if out[i:j].any():
            continue
        out[i:j] = 2
        out[i] = 1
    return out


def _values(words: list[str]) -> list[str]:
    """What the patterns' spans in a window hide."""
    text = " ".join(words)
    return [ASSIGN.match(text[a:b])[2] if k == 0 else text[a:b] for a, k, b in pattern_spans(text)]


def transplants(hits: list[list[str]], quiet: list[list[str]], most: int, seed: int = 13) -> list[tuple[list[str], np.ndarray]]:
    """Windows of quiet text with a value put in, and their labels: bare, under a word of that text, or behind a prefix.

    A value's characters are dealt anew and its length changes; some are of letters alone.
    """
    rng = np.random.default_rng(seed)
    values = [v for words in hits for v in _values(words)]
    every = sorted({c for v in values for c in v if c.isascii() and c.isalnum()})
    letters = sorted({x for c in every if c.isalpha() for x in (c.lower(), c.upper())}) or every
    out = []
    for i in range(most if quiet and every else 0):
        value = values[i % len(values)]
        own = sorted({c for c in value if c.isascii() and c.isalnum()}) or every
        kind = (own, every, letters)[i % 3]
        new = "".join(rng.choice(kind, int(rng.integers(14, 41))))
        around = quiet[int(rng.integers(len(quiet)))]
        plain = [w for w in around if w.isalpha() and w.isascii()] or ["value"]
        word = plain[int(rng.integers(len(plain)))].lower()
        put = ([new], [f"{word}={new}"], [f"{word}:", new], [f"{word[:3]}_{new}"], [f"{word}_{plain[0].lower()}={new}"], [word.capitalize(), new])[int(rng.integers(6))]
        at = int(rng.integers(len(around) + 1))
        gold = np.zeros(len(around) + len(put), np.int64)
        gold[at + len(put) - 1] = 1
        out.append(([*around[:at], *put, *around[at:]], gold))
    return out


def fit_secrets(docs: DataFrame, rows: int = 20_000, quiet_every: int = 2, examples: int = 4000, planted: int = 1500, bits: int = 16) -> crf.Crf | None:
    """Learn from words around the patterns' spans in about ``rows`` texts, chosen repeatably by id.

    Of the other texts of that sample every ``quiet_every``-th gives one window of words. At most ``examples`` windows
    of each kind, the first by a hash of their words, go to the fit, and ``planted`` transplants. None without any example.
    """
    total = docs.count()
    if not total:
        return None

    def windows(batches):
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            words, maybe, kinds = words_of(texts), candidates(texts), _file_kind(texts)
            plain = [not any(c.isdigit() for c in w) for w in words.vocabulary]
            out: list[tuple[int, int, list[str], bytes]] = []
            for i in range(batch.num_rows):
                a, b = words.offsets[i], words.offsets[i + 1]
                gold = np.zeros(b - a, np.int64)
                if maybe[i].any():
                    text = texts[i].as_py()
                    gold = _gold(text, pattern_spans(text, tuple(maybe[i])), b - a)
                hits = np.flatnonzero(gold == 1)
                if len(hits):
                    near = sorted({int(h) // WINDOW for h in hits})
                elif (b - a) and int(batch.column("row_key")[i].as_py()) % quiet_every == 0:
                    # One window anywhere, and the one with the longest word that has no digit: ordinary words can be long.
                    size = np.array([len(words.vocabulary[c]) if plain[c] else 0 for c in words.codes[a:b]])
                    near = sorted({int(batch.column("row_key")[i].as_py()) // quiet_every % (-(-int(b - a) // WINDOW)), int(size.argmax()) // WINDOW})
                else:
                    continue
                for w in near:
                    lo, hi = max(0, (w - 1) * WINDOW), min(b - a, (w + 2) * WINDOW)
                    out.append((int(bool(len(hits))), int(kinds[i]), [words.vocabulary[c] for c in words.codes[a + lo : a + hi]], gold[lo:hi].astype(np.int8).tobytes()))
            if out:
                hit, kind, text_words, gold_bytes = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(kind, pa.int32()), pa.array(text_words, pa.list_(pa.string())), pa.array(gold_bytes, pa.binary())], ["hit", "kind", "words", "gold"])

    key = F.pmod(F.xxhash64(F.lit(41), F.col("doc_id")), F.lit(1 << 30))
    sample = docs.select("text", key.alias("row_key")).where(share(F.col("doc_id"), min(1.0, rows / total), 31)) if rows < total else docs.select("text", F.coalesce(key, F.lit(1)).alias("row_key"))
    found = sample.mapInArrow(windows, "hit int, kind int, words array<string>, gold binary")
    found = found.withColumn("place", F.xxhash64("words", "gold")).orderBy("place", "kind")
    chosen = found.where("hit = 1").limit(examples).union(found.where("hit = 0").limit(examples))
    # Their number is bounded, so one task learns from them; of all this only the model comes to the driver.
    fitted = chosen.repartition(1).sortWithinPartitions(F.desc("hit"), "place", "kind").select("hit", "kind", "words", "gold")
    model = fitted.mapInArrow(lambda batches: _fit(batches, planted, bits), "model binary").toArrow().column("model").to_pylist()
    return pickle.loads(model[0]) if model else None


def _fit(batches: Iterable[pa.RecordBatch], planted: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The model, pickled, of all windows, those with a secret first; nothing without any of these."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    got, quiet = [r for r in rows if r["hit"]], [r for r in rows if not r["hit"]]
    if not got:
        return
    new = transplants([r["words"] for r in got], [r["words"] for r in quiet], planted)
    kinds = [r["kind"] for r in quiet] or [0]
    got += quiet + [{"kind": kinds[i % len(kinds)], "words": w, "gold": g.astype(np.int8).tobytes()} for i, (w, g) in enumerate(new)]
    flat = pa.array([w for r in got for w in r["words"]], pa.string()).dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum([len(r["words"]) for r in got])])
    gold = np.concatenate([np.frombuffer(r["gold"], np.int8) for r in got]).astype(np.int64)
    kind = np.repeat(_file_feature(np.array([r["kind"] for r in got]), bits), np.diff(offsets))
    model = crf.train(LABELS, features, flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64), offsets, gold, extra=kind, bits=bits, rounds=40)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def tag(scores: crf.WordScores, texts: pa.Array) -> tuple[np.ndarray, Words]:
    """The decoded label of each word, and the words."""
    words = words_of(texts)
    score = scores.emissions(words.vocabulary, words.codes, words.offsets)
    if len(score):
        score += np.repeat(scores.model.weights[_file_feature(_file_kind(texts), scores.model.bits)], np.diff(words.offsets), axis=0)
    return crf.viterbi(scores.model, score, words.offsets), words


def _tagged_spans(text: str, labels: np.ndarray, taken: list[Span]) -> list[Span]:
    """Spans of begin-inside runs, without wrapping marks, where no pattern's span is."""
    found: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if labels[i]:
            if labels[i] == 2 and last == i - 1:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            last = i
    out: list[Span] = []
    for a, b in found:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip(_WRAP)), b - (len(piece) - len(piece.rstrip(_WRAP)))
        if a < b:
            out.append((a, 3, b))
    return _apart(sorted(out), taken)


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap none of those taken; both by start."""
    out, k, reach = [], 0, -1
    for a, kind, b in spans:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= a:
            out.append((a, kind, b))
    return out


def spans_of(scores: crf.WordScores | None, texts: pa.Array) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and the added ones."""
    texts = pc.fill_null(texts, "")
    maybe = candidates(texts)
    labels, words = tag(scores, texts) if scores else (np.zeros(0, np.int8), None)
    marked = set(np.unique(words.rows[labels > 0]).tolist()) if words else set()
    out = []
    for i, some in enumerate(maybe.any(axis=1)):
        base: list[Span] = []
        more: list[Span] = []
        if some or i in marked:
            text = texts[i].as_py()
            base = pattern_spans(text, tuple(maybe[i])) if some else []
            if i in marked:
                more = _tagged_spans(text, labels[words.offsets[i] : words.offsets[i + 1]], base)
        out.append((base, more))
    return out


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, model: crf.Crf | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row; offsets are code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scores = crf.WordScores(shared.value, features) if shared.value else None
        for batch in slices(batches):
            found = spans_of(scores, batch.column("text"))
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(3)]
            hashes = [hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found]
            spans = [_said(base + more) for base, more in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: crf.Crf | None, mark: str = "[SECRET]", length_column: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark`` in ``text``; a length column follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    follows = length_column in docs.columns

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, _, b in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches):
        scores = crf.WordScores(shared.value, features) if shared.value else None
        for batch in slices(batches):
            column = batch.schema.get_field_index("text")
            texts = batch.column(column)
            found = [base + more for base, more in spans_of(scores, texts)]
            changed = [i for i, s in enumerate(found) if s]
            if changed:
                values = texts.to_pylist()
                for i in changed:
                    values[i] = clean(values[i], found[i])
                new = pa.array(values, texts.type)
                batch = batch.set_column(column, batch.schema.field(column), new)
                if follows:
                    at = batch.schema.get_field_index(length_column)
                    hit = np.zeros(len(found), bool)
                    hit[changed] = True
                    size = pc.if_else(pa.array(hit), pc.utf8_length(new).cast(batch.schema.field(at).type), batch.column(at))
                    batch = batch.set_column(at, batch.schema.field(at), size)
            yield batch

    return docs.mapInArrow(run, docs.schema)
