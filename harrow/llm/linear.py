"""Logistic regression on hashed features of documents, with numpy.

A document's features are 64-bit hashes (a set). A model keeps only the features that
tell the classes apart best (G statistic of document counts in the training rows),
so a document is a handful of known features, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import LETTERS, SYMBOLS, Words, mix

_U = np.uint64
_FRONT_BITS = 20


def word_features(words: Words, units: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(unit, feature) of words and their first bytes, repeats included; ``units``: of each word."""
    docs, feats = [units], [words.hashes]
    for n in prefixes:
        long = words.ends - words.starts > n
        starts = words.starts[long]
        docs.append(units[long])
        feats.append(mix(words.span_hashes(starts, starts + n) ^ _U(n)))
    return np.concatenate(docs), np.concatenate(feats)


def document_features(data: np.ndarray, offsets: np.ndarray, first: int, last: int, prefixes: tuple[int, ...] = (), symbols: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of words, their first bytes, and runs of symbols; repeats included."""
    words = Words(data, offsets, first, last, LETTERS)
    docs, feats = word_features(words, words.doc, prefixes)
    if symbols:
        runs = Words(data, offsets, first, last, SYMBOLS)
        docs, feats = np.concatenate((docs, runs.doc)), np.concatenate((feats, mix(runs.hashes ^ _U(0x5EED))))
    return docs, feats


def passage_features(data: np.ndarray, offsets: np.ndarray, first: int, last: int, size: int, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, feature) pairs and the document of each passage; passages are ``size`` words, every document has one."""
    words = Words(data, offsets, first, last, LETTERS)
    count = np.maximum(1, -(-words.per_doc // size))
    begin, base = np.cumsum(words.per_doc) - words.per_doc, np.cumsum(count) - count
    units = base[words.doc] + (np.arange(len(words.doc)) - begin[words.doc]) // size
    return *word_features(words, units, prefixes), np.repeat(np.arange(last - first), count)


class Vocabulary:
    """Known features, found by a small table of leading bits before the full hash is compared."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self._front: np.ndarray | None = None

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, hashes):
        self.hashes, self._front = hashes, None

    def find(self, docs: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, position of the known feature), ordered."""
        if self._front is None:
            self._front = np.zeros(1 << _FRONT_BITS, bool)
            self._front[(self.hashes >> _U(64 - _FRONT_BITS)).astype(np.int64)] = True
        maybe = np.flatnonzero(self._front[(feats >> _U(64 - _FRONT_BITS)).astype(np.int64)])
        feats, docs = feats[maybe], docs[maybe]
        if not len(self.hashes) or not len(feats):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, feats), len(self.hashes) - 1)
        real = self.hashes[at] == feats
        both = np.unique(docs[real].astype(np.int64) * len(self.hashes) + at[real])
        return both // len(self.hashes), both % len(self.hashes)


def distinct(docs: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, feature) pairs."""
    _, at = np.unique(mix(feats + docs.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_index=True)
    return docs[at], feats[at]


class TrainingSet:
    """(row, feature) pairs of the training rows; features of fewer than ``least_docs`` rows are left out."""

    def __init__(self, docs: np.ndarray, feats: np.ndarray, rows: int, least_docs: int = 3):
        hashes, ids, count = np.unique(feats, return_inverse=True, return_counts=True)
        keep = count >= least_docs
        new = np.cumsum(keep) - 1
        pairs = keep[ids]
        self.hashes = hashes[keep]
        self.docs, self.ids = docs[pairs].astype(np.int32), new[ids[pairs]].astype(np.int32)
        self.rows = rows

    def select(self, rows: np.ndarray, label: np.ndarray, most: int, only_positive: bool = False) -> np.ndarray:
        """Features (ascending) with the largest G statistic over ``rows``, whose labels are ``label``.

        ``only_positive``: features that are at least three times commoner with the label,
        and so clear that chance hardly makes one among all: a long text holds many words.
        """
        value = np.full(self.rows, -1.0)
        value[rows] = label
        v = value[self.docs]
        n1, n0 = max(1, int(label.sum())), max(1, int(len(label) - label.sum()))
        a = np.bincount(self.ids[v > 0], minlength=len(self.hashes)).astype(float)
        b = np.bincount(self.ids[v == 0], minlength=len(self.hashes)).astype(float)
        p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        both = (a + b + 1) / (n1 + n0 + 2)
        g = a * np.log(p / both) + b * np.log(q / both)
        clear = (g > max(3.0, np.log(max(1, len(g))) / 2)) & (p > 3 * q) if only_positive else g > 3
        at = np.flatnonzero((a + b >= 3) & clear)
        return np.sort(at[np.lexsort((at, -g[at]))[:most]])

    def pairs(self, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, position in ``chosen``) of the pairs that both name."""
        place, column = np.full(self.rows, -1), np.full(max(1, len(self.hashes)), -1)
        place[rows], column[chosen] = np.arange(len(rows)), np.arange(len(chosen))
        d, f = place[self.docs], column[self.ids] if len(self.ids) else np.zeros(0, np.int64)
        keep = (d >= 0) & (f >= 0)
        return d[keep], f[keep]


@dataclass
class Logistic:
    """Weights of known features, of dense columns (standardised), and the constant."""

    sparse: np.ndarray
    dense: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    constant: float

    def logit(self, docs: np.ndarray, feats: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = standard(dense, self.centre, self.scale) @ self.dense + self.constant
        return z + np.bincount(docs, weights=self.sparse[feats], minlength=len(dense))


def standard(dense: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Dense columns in standard deviations, held to six of them."""
    return np.clip((dense - centre) / scale, -6, 6)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(docs: np.ndarray, feats: np.ndarray, features: int, dense: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 150) -> Logistic:
    """L2-penalised maximum likelihood by accelerated gradient steps. One class only: its (smoothed) share."""
    n = len(label)
    weight = np.ones(n) if weight is None else weight
    centre = dense.mean(axis=0) if n else np.zeros(dense.shape[1])
    scale = dense.std(axis=0) if n else np.ones(dense.shape[1])
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = standard(dense, centre, scale)
    share = (float((weight * label).sum()) + 0.5) / (float(weight.sum()) + 1)
    model = Logistic(np.zeros(features), np.zeros(dense.shape[1]), centre, scale, float(np.log(share / (1 - share))))
    if n == 0 or label.min() == label.max():
        return model
    # The step is the inverse of the curvature's bound: a quarter of the design's largest
    # squared singular value, by power iteration.
    u, size = np.ones(n), 1.0
    for _ in range(30):
        parts = np.bincount(feats, weights=u[docs], minlength=features), x.T @ u, u.sum()
        u = x @ parts[1] + parts[2] + np.bincount(docs, weights=parts[0][feats], minlength=n)
        size = float(np.linalg.norm(u)) or 1.0
        u = u / size
    step = 1 / (1.1 * size / 4 * float(weight.max()) + penalty)
    ws, wd, c = model.sparse.copy(), model.dense.copy(), model.constant
    ps, pd, pc = ws, wd, c
    for t in range(rounds):
        k = t / (t + 3)
        ys, yd, yc = ws + k * (ws - ps), wd + k * (wd - pd), c + k * (c - pc)
        r = weight * (sigmoid(x @ yd + yc + np.bincount(docs, weights=ys[feats], minlength=n)) - label)
        ps, pd, pc = ws, wd, c
        ws = ys - step * (np.bincount(feats, weights=r[docs], minlength=features) + penalty * ys)
        wd = yd - step * (x.T @ r + penalty * yd)
        c = yc - step * float(r.sum())
    return Logistic(ws, wd, centre, scale, c)


def folds(keys: np.ndarray, count: int) -> np.ndarray:
    """A fold for each key; rows of one key share it."""
    return (mix(keys.astype(np.int64).view(np.uint64) + _U(77)) % _U(count)).astype(np.int64)
