"""A linear-chain conditional random field over words, in numpy.

A word's features are hashed once per distinct word. Each feature has a weight
per label in three roles: of the word itself, of the word before, of the word
after. A chain is a run of at most ``CHAIN`` words of one text; neighbours are
looked up across chain bounds, so only the transition between two chains is
left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np

CHAIN = 64
ROLES = 3  # own, before, after
BLOCK = 4096  # chains worked on at once

# Distinct words whose scores a task keeps; then it starts afresh.
KEPT_WORDS = 400_000

Features = Callable[[str], tuple[Sequence[str], Sequence[str]]]


@dataclass
class Crf:
    """Hashed weights ``(2**bits, labels)`` and the chain's start and transition scores."""

    labels: tuple[str, ...]
    bits: int
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray


def hashed(features: Features, words: Sequence[str], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each role the flat feature ids of all words and where each word's begin."""
    mask = (1 << bits) - 1
    flat: list[list[int]] = [[], [], []]
    begins: list[list[int]] = [[], [], []]
    for w in words:
        own, near = features(w)
        for role in range(ROLES):
            begins[role].append(len(flat[role]))
            flat[role] += [crc32(f.encode("utf-8", "surrogatepass"), role) & mask for f in (near if role else own)]
    return [np.array(x, np.int64) for x in flat], [np.array(x, np.int64) for x in begins]


class WordScores:
    """Label scores of words in each role, computed once per distinct word."""

    def __init__(self, model: Crf, features: Features):
        self.model, self.features = model, features
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, ROLES, len(self.model.labels)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for the words."""
        if len(self.index) > KEPT_WORDS:
            self._reset()
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            first = len(self.index)
            while len(self.table) < first + len(fresh):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            flat, begins = hashed(self.features, fresh, self.model.bits)
            for role in range(ROLES):
                self.table[first : first + len(fresh), role] = np.add.reduceat(self.model.weights[flat[role]], begins[role], axis=0)
            at[new] = np.arange(first, first + len(fresh))
            self.index.update(zip(fresh, range(first, first + len(fresh))))
        return at

    def emissions(self, words: list[str], codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Label scores of every word in its place, ``(words, labels)``."""
        at = self.rows(words)[codes]
        return placed(self.table, at, offsets)


def placed(table: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    score = table[at, 0].astype(np.float32)
    if len(at) > 1:
        first = np.zeros(len(at) + 1, bool)
        first[offsets] = True
        inner = ~first[1:-1]  # a neighbour of the same text
        score[1:] += table[at[:-1], 1] * inner[:, None]
        score[:-1] += table[at[1:], 2] * inner[:, None]
    return score


def chains(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each chain, the longest first."""
    size = np.diff(offsets)
    parts = -(-size // CHAIN)
    owner = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][owner] + nth * CHAIN
    length = np.minimum(CHAIN, offsets[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def _blocks(begin: np.ndarray, length: np.ndarray):
    for i in range(0, len(begin), BLOCK):
        b, n = begin[i : i + BLOCK], length[i : i + BLOCK]
        place = b[:, None] + np.arange(n[0])[None, :]
        real = np.arange(n[0])[None, :] < n[:, None]
        yield np.where(real, place, b[:, None]), real, n


def marginals(model: Crf, score: np.ndarray, offsets: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward: the probability of each label at each word. ``pairs`` gathers expected transitions."""
    out = np.empty(score.shape, np.float32)
    if not len(score):
        return out
    move, first = np.exp(model.moves).astype(np.float32), np.exp(model.start).astype(np.float32)
    for place, real, length in _blocks(*chains(offsets)):
        e = score[place]
        psi = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float32)
        steps = psi.shape[1]
        ahead, back = np.empty_like(psi), np.ones_like(psi)
        a = psi[:, 0] * first
        ahead[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            live = int(np.searchsorted(-length, -t, side="left"))  # chains that reach t
            a = (ahead[:live, t - 1] @ move) * psi[:live, t]
            ahead[:live, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            live = int(np.searchsorted(-length, -(t + 1), side="left"))
            b = psi[:live, t + 1] * back[:live, t + 1]
            if pairs is not None:
                x = ahead[:live, t, :, None] * move[None] * b[:, None, :]
                pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            back[:live, t] = b / b.sum(axis=1, keepdims=True)
        p = np.where(real[..., None], ahead * back, 1)
        p /= p.sum(axis=2, keepdims=True)
        out[place[real]] = p[real]
    return out


def viterbi(model: Crf, score: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The best label of each word; ties go to the label named first."""
    out = np.zeros(len(score), np.int8)
    if not len(score):
        return out
    for place, real, length in _blocks(*chains(offsets)):
        e = score[place]
        n, steps, k = e.shape
        best, came = e[:, 0] + model.start, np.zeros((n, steps, k), np.int8)
        for t in range(1, steps):
            live = int(np.searchsorted(-length, -t, side="left"))
            x = best[:live, :, None] + model.moves[None]
            came[:live, t] = x.argmax(axis=1)
            best[:live] = x.max(axis=1) + e[:live, t]
        path, now = np.zeros((n, steps), np.int8), best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            path[:live, t] = now[:live]
            now[:live] = came[np.arange(live), t, now[:live]]
        out[place[real]] = path[real]
    return out


def train(labels: tuple[str, ...], features: Features, words: list[str], codes: np.ndarray, offsets: np.ndarray, gold: np.ndarray, extra: np.ndarray | None = None, bits: int = 18, rounds: int = 40, rate: float = 0.3, decay: float = 0.3) -> Crf:
    """Maximum likelihood with an L2 penalty, by full-batch Adam.

    ``gold`` holds a label index per word. ``extra`` may hold one further hashed feature id per word, such as that of its file.
    """
    k, n = len(labels), len(codes)
    model = Crf(labels, bits, np.zeros((1 << bits, k), np.float32), np.zeros(k), np.zeros((k, k)))
    if not n:
        return model
    flat, begins = hashed(features, words, bits)
    owner = [np.repeat(np.arange(len(words)), np.diff(np.append(b, len(f)))) for f, b in zip(flat, begins)]
    used, at = np.unique(np.concatenate([*flat, *([extra] if extra is not None else [])]), return_inverse=True)
    ends = np.cumsum([len(f) for f in flat])
    place = [at[e - len(f) : e] for f, e in zip(flat, ends)]
    begin, length = chains(offsets)
    heads = np.zeros(n, bool)
    heads[begin] = True
    hit = np.zeros((n, k), np.float32)
    hit[np.arange(n), gold] = 1
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][~heads[1:]], gold[1:][~heads[1:]]), 1)
    started = hit[begin].sum(axis=0)
    theta = [np.zeros((len(used), k)), np.zeros(k), np.zeros((k, k))]
    mean, square = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    inner = ~first[1:-1]
    for step in range(1, rounds + 1):
        w, model.start, model.moves = theta
        table = np.zeros((len(words), ROLES, k), np.float32)
        for role in range(ROLES):
            table[:, role] = np.add.reduceat(w[place[role]], begins[role], axis=0)
        score = placed(table, codes, offsets)
        if extra is not None:
            score += w[at[ends[-1] :]]
        pairs = np.zeros((k, k))
        p = marginals(model, score, offsets, pairs)
        rest = hit - p
        grown = np.zeros((len(used), k))
        for role, (to, off) in enumerate(((codes, rest), (codes[:-1], rest[1:] * inner[:, None]), (codes[1:], rest[:-1] * inner[:, None]))):
            for j in range(k):
                by_word = np.bincount(to, off[:, j], len(words))
                grown[:, j] += np.bincount(place[role], by_word[owner[role]], len(used))
        if extra is not None:
            for j in range(k):
                grown[:, j] += np.bincount(at[ends[-1] :], rest[:, j], len(used))
        slope = [grown - decay * w, started - p[begin].sum(axis=0) - decay * model.start, seen - pairs - decay * model.moves]
        theta = list(theta)
        for i, g in enumerate(slope):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    model.weights[used], model.start, model.moves = theta[0], theta[1], theta[2]
    return model
