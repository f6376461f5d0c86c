"""Vectorised word scanning over Arrow string columns.

A word is a run of bytes outside ``0x20 0x09-0x0D``, with A-Z lower-cased. Words
are hashed to 64 bits straight from the UTF-8 buffer, a block of whole documents
at a time, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_SEPARATORS = [0x20, *range(0x09, 0x0E)]
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[_SEPARATORS] = False
#: Letters and digits, and every byte of a non-ASCII character.
LETTERS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: ASCII punctuation and symbols.
SYMBOLS = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, _U(_BASE)), np.full(size, _U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Words of the documents ``first .. last`` (exclusive) of a batch."""

    __slots__ = ("_down", "_prefix", "data", "doc", "ends", "first", "hashes", "per_doc", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, members: np.ndarray = _IN_WORD, fold: bool = True):
        lo, hi = int(offsets[first]), int(offsets[last])
        own = offsets[first : last + 1] - lo
        raw = _LOWER[data[lo:hi]] if fold else data[lo:hi]
        inside = members[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        if len(raw):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            filled = own[1:] > own[:-1]
            before[own[:-1][filled]] = False
            after[own[1:][filled] - 1] = False
        self.data, self.first = raw, first
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(own, self.starts, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=last - first)
        up, down = _powers(len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=prefix[1:])
        self._prefix, self._down = prefix, down
        self.hashes = self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any stretches of bytes; those of equal bytes are equal."""
        return mix((self._prefix[ends] - self._prefix[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles of ``width`` words, ascending.

    With fewer words (but some) the whole sequence is the one shingle.
    """
    n_docs = len(words.per_doc)
    h, count = words.hashes, words.per_doc
    begin = np.concatenate(([0], np.cumsum(count)))
    made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    out = np.empty(int(made.sum()), np.uint64)
    at = np.concatenate(([0], np.cumsum(made)))
    if len(h) >= width:
        m = len(h) - width + 1
        rolled = np.zeros(m, np.uint64)
        for k in range(width):
            rolled += h[k : k + m] * factors[k]
        rolled = mix(rolled)
        long = np.flatnonzero(count >= width)
        if len(long):
            same = words.doc[:m] == words.doc[width - 1 :]
            target = np.repeat(count >= width, made)
            out[target] = rolled[same]
    for d in np.flatnonzero((count > 0) & (count < width)):
        own = h[begin[d] : begin[d + 1]]
        out[at[d]] = mix((own * factors[: len(own)]).sum(keepdims=True) + np.array([len(own)], np.uint64) * _U(0xA0761D6478BD642F))[0]
    for d in range(n_docs):
        out[at[d] : at[d + 1]].sort()
    fresh = np.ones(len(out), bool)
    if len(out) > 1:
        fresh[1:] = out[1:] != out[:-1]
        fresh[at[:-1][made > 0]] = True
    sizes = np.add.reduceat(np.concatenate((fresh.astype(np.int64), [0])), at[:-1]) if n_docs else np.zeros(0, np.int64)
    sizes[made == 0] = 0
    return out[fresh], np.concatenate(([0], np.cumsum(sizes)))
