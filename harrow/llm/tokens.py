"""Token ids of whole texts, one call of the tokenizer per new chunk rather than per text.

Byte-pair merges never cross the pieces that a tokenizer's pre-tokenizer cuts, so a
text's ids are those of its chunks, which spaces and line feeds bound, in turn.
Chunks repeat a lot. They are told apart by 64-bit hashes taken straight from the
UTF-8 buffer, and their ids kept in flat arrays of bounded size (some 30 bytes a
chunk), so a block of documents is looked up and put together without an object a
word.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .words import Words, blocks, mix, utf8

#: Chunks and ids that a worker keeps; beyond, it starts anew with the latest.
MOST_CHUNKS = 1_000_000
MOST_IDS = 8_000_000
RECENT = 100_000
_U = np.uint64
_CHUNK = np.ones(256, bool)
_CHUNK[[0x20, 0x0A]] = False
_AFTER_SPACE, _AFTER_LINE_FEED, _AT_START = 0, 1, 2
#: White space other than the space and the line feed.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Latin letters that are one code point in every normal form, then a few ASCII marks
#: (no apostrophe: it may start a contraction), which are a piece of their own.
_PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]{0,4})")
#: Byte-level BPE writes bytes without a printable sign of their own as code points from 256 on.
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


class _Table:
    """key -> (place, size) in one pool of ids; a size of -1 marks a chunk that can't stand alone."""

    def __init__(self, code: str):
        self.code = code
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.main = self.recent = (np.zeros(0, np.uint64), none, none)
        self.pool, self.used = np.zeros(1 << 16, self.code), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, known) of ascending distinct keys."""
        place, size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for own, places, sizes in (self.main, self.recent):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                place[hit], size[hit] = places[at[hit]], sizes[at[hit]]
                known |= hit
        return place, size, known

    def add(self, keys: np.ndarray, ids: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) of new ascending keys."""
        wide = np.dtype(self.code).itemsize
        size = np.array([-1 if i is None else len(i) // wide for i in ids], np.int64)
        taken = np.maximum(size, 0)
        place = self.used + np.cumsum(taken) - taken
        more = np.frombuffer(b"".join(i for i in ids if i), self.code)
        if self.used + len(more) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(more)), self.code)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(more)] = more
        self.used += len(more)
        self.recent = self._merged(self.recent, (keys, place, size))
        if len(self.recent[0]) > RECENT:
            self.main, self.recent = self._merged(self.main, self.recent), tuple(x[:0] for x in self.recent)
        return place, size

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate((a[0], b[0])), kind="stable")
        return tuple(np.concatenate((x, y))[order] for x, y in zip(a, b, strict=True))

    @property
    def full(self) -> bool:
        return len(self.main[0]) > MOST_CHUNKS or self.used > MOST_IDS


class ChunkEncoder:
    """Encodes with a ``tokenizers`` file; ``kind`` says how spaces act.

    ``dropped``: lower-casing, white space only separates (it is never part of a token).
    ``leading``: byte-level BPE, where one space belongs to the word after it; texts
    with runs of white space, or rarer white space next to a space, are encoded whole.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in ("dropped", "leading"):
            raise ValueError(f"unknown kind {kind!r}")
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.marks: dict[str, bytes] = {}
        self.line_feed = self._raw("\n")
        self.table = _Table(self.code)

    def _raw(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _make(self, chunks: list[str], before: list[int]) -> list[bytes | None]:
        """Ids of new chunks: a plain word (and marks) goes straight to the merges, the rest the long way.

        None for a chunk whose cut from its neighbours hangs on these.
        """
        out: list[bytes | None] = []
        rest, texts, lower = [], [], self.kind == "dropped"
        code, merge, marks = self.code, self.model.tokenize, self.marks
        for i, (c, place) in enumerate(zip(chunks, before, strict=True)):
            head = "" if lower or place != _AFTER_SPACE else " "
            feed = b"" if lower or place != _AFTER_LINE_FEED else self.line_feed
            if plain := _PLAIN_WORD.fullmatch(c):
                word, mark = plain.groups()
                word = head + (word.lower() if lower else word)
                ids = feed + array(code, [t.id for t in merge(word.encode().decode("latin-1").translate(_BYTE_SIGNS))]).tobytes()
                if mark:
                    if mark not in marks:
                        if len(marks) > 20_000:
                            marks.clear()
                        marks[mark] = self._raw(mark)
                    ids += marks[mark]
                out.append(ids)
            elif not lower and (_RARE_SPACE.match(c[:1]) or _RARE_SPACE.match(c[-1:])):
                out.append(None)
            else:
                out.append(feed)
                rest.append(i)
                texts.append(head + c)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] += array(code, e.ids).tobytes()
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in turn, number of ids of each)."""
        words = Words(data, offsets, first, last, _CHUNK, fold=self.kind == "dropped")
        n, raw, own = last - first, words.data, offsets[first : last + 1] - offsets[first]
        keys, before = words.hashes, np.zeros(len(words.starts), np.int64)
        odd = np.zeros(n, bool)
        if self.kind == "leading":
            before = np.where(raw[np.maximum(words.starts - 1, 0)] == 0x0A, _AFTER_LINE_FEED, _AFTER_SPACE)
            before[words.starts == own[words.doc]] = _AT_START
            keys = mix(keys + before.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            # White space at an edge of a text, or next to other white space: words are
            # fewer than separators and one.
            gaps = np.diff(np.concatenate(([0], np.cumsum(~_CHUNK[raw])))[own])
            odd = (gaps + 1 != words.per_doc) & (np.diff(own) > 0)
        if odd.any():
            keep = ~odd[words.doc]
            keys, before, docs, starts, ends = keys[keep], before[keep], words.doc[keep], words.starts[keep], words.ends[keep]
        else:
            docs, starts, ends = words.doc, words.starts, words.ends
        if self.table.full:
            self.table.clear()
        some, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place, size, known = self.table.find(some)
        new = np.flatnonzero(~known)
        if len(new):
            at = index[new]
            text = raw.tobytes()
            chunks = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            place[new], size[new] = self.table.add(some[new], self._make(chunks, before[at].tolist()))
        sizes = size[inverse]
        if (sizes < 0).any():
            odd[docs[sizes < 0]] = True
            keep = ~odd[docs]
            inverse, sizes, docs = inverse[keep], sizes[keep], docs[keep]
        total = int(sizes.sum())
        ids = self.table.pool[np.repeat(place[inverse] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]
        counts = np.bincount(docs, weights=sizes, minlength=n).astype(np.int64)
        if odd.any():
            ends_at = np.cumsum(counts)
            parts, done = [], 0
            for d in np.flatnonzero(odd).tolist():
                whole = np.frombuffer(self._raw(raw[own[d] : own[d + 1]].tobytes().decode("utf-8", "surrogatepass")), self.code)
                parts += [ids[done : ends_at[d]], whole]
                done, counts[d] = ends_at[d], len(whole)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each), each text closed by ``end_id``. Null is empty."""
        data, offsets = utf8(column)
        parts = [self._block(data, offsets, first, last) for first, last in blocks(offsets, 1 << 20)]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, self.code)
        counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids (``code`` wide) of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ChunkEncoder(path, kind)
    return _ENCODERS[path, kind]


def binary_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a text, over the ids as they lie."""
    offsets = np.concatenate(([0], np.cumsum(counts) * ids.itemsize)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
