"""SentencePiece BPE ids of whole texts and back, without walking the merges of a text.

Merging the best adjacent pair until none is left gives the one cut of a text in which
every two neighbours are compatible: merged on their own, the two come out as the same
two. (The part of a merge history that lies inside a run of final pieces is the history of
that run.) So each prefix of a text has one last piece: the piece that ends there and is
compatible with the last piece of the prefix before it. An automaton finds all pieces that
end at each place, the table of last pieces is filled from left to right, and the ids are
read off it backwards, in time linear in the text however long a run without a cut is.

Texts are first cut where no piece of the vocabulary holds the two adjacent bytes (a merge
can't cross such a place: mostly word starts, line feeds, digits). Stretches repeat a lot;
they are told apart by 64-bit hashes taken from the UTF-8 buffer and their ids kept in flat
arrays of bounded size, so a block of documents is looked up and put together at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .tokens import _Table
from .words import _powers, blocks, mix, utf8

BLOCK_BYTES = 1 << 20
#: Verdicts on pairs that a worker keeps (some 100 bytes each); beyond, it starts anew.
MOST_PAIRS = 1_000_000
SPACE, REPLACEMENT = "▁", "�".encode()
_U = np.uint64
_AT_START = _U(0xD1B54A32D192ED03)
#: Above all ids: a character that is no piece, and the place before the first piece.
_BARE, _NOTHING, _SPAN = 1 << 22, (1 << 22) - 1, 1 << 23
_CODERS: dict[str, PieceCoder] = {}


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    """A BPE model file with byte fallback, whose normaliser only marks spaces and the text's start."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if model.normalize("ﬁ  Ａ ") != f"{SPACE}ﬁ{SPACE * 2}Ａ{SPACE}":
            raise ValueError("the model's normaliser changes more than spaces and the start of a text")
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.full(256, -1)
        self.plain = np.zeros(size, bool)
        surfaces, scores = [], {}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                surfaces.append(bytes([int(name[1:-1], 16)]))
            elif model.is_unknown(i):
                surfaces.append(" ⁇ ".encode())
            elif model.is_control(i):
                surfaces.append(b"")
            elif model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                self.plain[i] = True
                surfaces.append(name.replace(SPACE, " ").encode())
                scores[surfaces[-1].decode()] = model.get_score(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no pieces for bytes")
        self.unknown = model.unk_id()
        self.byte_piece = np.zeros(size, bool)
        self.byte_piece[self.byte_ids] = True
        self.lengths = np.array([len(s) for s in surfaces])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.scores = scores
        self.texts = [s.decode() if p else "" for s, p in zip(surfaces, self.plain, strict=True)]
        self.automaton = ahocorasick.Automaton()
        self.joined = np.zeros((256, 256), bool)
        for i in np.flatnonzero(self.plain).tolist():
            self.automaton.add_word(self.texts[i], (len(self.texts[i]), i))
            own = np.frombuffer(self.texts[i].encode(), np.uint8)
            self.joined[own[:-1], own[1:]] = True
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.table = _Table("H" if size <= 1 << 16 else "I")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its merges: the best pair first, of equals the leftmost."""
        parts, scores = list(text), self.scores
        low = float("-inf")
        ranks = [scores.get(a + b, low) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := max(ranks)) > low:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = scores.get(parts[at - 1] + parts[at], low)
            if at < len(ranks):
                ranks[at] = scores.get(parts[at] + parts[at + 1], low)
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether ``piece`` stays itself after ``before`` (at the start: on its own), worked out anew."""
        last = self.texts[piece]
        first = "" if before == _NOTHING else chr(before - _BARE) if before >= _BARE else self.texts[before]
        fits = self.merged(first + last) == ([first, last] if first else [last])
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[before * _SPAN + piece] = fits
        return fits

    def stretch_ids(self, text: str) -> list[int]:
        """Ids of a stretch (spaces as spaces): the table of last pieces, read backwards."""
        last, known, fits = [-1] * len(text), self.pairs, self._fits
        for end, (size, piece) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            at = end - size
            before = _NOTHING
            if at >= 0:
                before = last[at]
                if before < 0:  # no piece ends there: the character is none
                    before = last[at] = _BARE + ord(text[at])
            found = known.get(before * _SPAN + piece)
            if fits(before, piece) if found is None else found:
                last[end] = piece
        ids, at = [], len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece < 0 or piece >= _BARE:
                ids += [int(self.byte_ids[b]) for b in reversed(text[at].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                ids.append(piece)
                at -= len(self.texts[piece])
        return ids[::-1]

    def _block(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in turn, number of ids of each); ``edges`` are their byte offsets in ``raw``."""
        if not len(raw):
            return np.zeros(0, self.table.code), np.zeros(len(edges) - 1, np.int64)
        begins = np.ones(len(raw), bool)
        begins[1:] = ~self.joined[raw[:-1], raw[1:]] & (raw[1:] & 0xC0 != 0x80)
        firsts = edges[:-1][edges[1:] > edges[:-1]]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        del sums
        leading = np.searchsorted(starts, firsts)
        keys[leading] = mix(keys[leading] + _AT_START)
        if self.table.full:
            self.table.clear()
        some, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place, size, known = self.table.find(some)
        new = np.flatnonzero(~known)
        if len(new):
            at, text = index[new], raw.tobytes()
            opening = np.isin(at, leading)
            made = []
            for a, b, opens in zip(starts[at].tolist(), ends[at].tolist(), opening.tolist(), strict=True):
                stretch = text[a:b].decode("utf-8", "surrogatepass")
                made.append(np.array(self.stretch_ids(" " + stretch if opens else stretch), self.table.code).tobytes())
            place[new], size[new] = self.table.add(some[new], made)
        sizes = size[inverse]
        ids = self.table.pool[np.repeat(place[inverse] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        doc = np.searchsorted(edges, starts, "right") - 1
        return ids, np.bincount(doc, weights=sizes, minlength=len(edges) - 1).astype(np.int64)

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids of these texts in turn, number of ids of each), a block of texts at a time. Null is empty."""
        if pc.any(pc.match_substring(column, SPACE)).as_py():
            column = pc.replace_substring(column, SPACE, " ")
        data, offsets = utf8(column)
        for i, j in blocks(offsets, BLOCK_BYTES):
            yield i, j, *self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def decode_ids(self, ids: list[int]) -> bytes:
        """UTF-8 of one sequence of any ids: the rules one by one."""
        out, run, opening = b"", b"", True
        for i in [*ids, None]:
            if i is not None and self.byte_piece[i]:
                run += bytes([int(self.surfaces[self.places[i]])])
                continue
            at = 0
            while at < len(run):
                wide = 1 if run[at] < 0xC0 else 2 if run[at] < 0xE0 else 3 if run[at] < 0xF0 else 4
                try:
                    run[at : at + wide].decode()
                except UnicodeDecodeError:
                    out, at = out + REPLACEMENT, at + 1
                else:
                    out, at = out + run[at : at + wide], at + wide
            run = b""
            if i is None:
                break
            own = self.surfaces[self.places[i] : self.places[i] + self.lengths[i]].tobytes()
            opening = opening and not out
            if opening and self.plain[i] and own.startswith(b" "):
                own, opening = own[1:], False
            out += own
        return out

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of many sequences: surfaces are gathered at once; sequences with odd bytes, controls or unknowns go one by one."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.names)):
            raise ValueError(f"ids must be 0 to {len(self.names) - 1}")
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        raw = self.surfaces[np.repeat(self.places[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]
        before = np.concatenate(([0], np.cumsum(counts)))
        edges = np.concatenate(([0], np.cumsum(sizes)))[before]
        full = np.flatnonzero(counts)
        opens = full[self.plain[ids[before[full]]] & (raw[np.minimum(edges[full], max(total - 1, 0))] == 0x20)] if total else full[:0]
        doc = np.repeat(np.arange(len(counts)), counts)
        odd = np.unique(doc[~self.plain[ids] & ~self.byte_piece[ids]])
        for d in np.setdiff1d(np.unique(doc[self.byte_piece[ids]]), odd).tolist():
            try:
                raw[edges[d] : edges[d + 1]].tobytes().decode()
            except UnicodeDecodeError:
                odd = np.append(odd, d)
        if len(odd):
            own = {d: self.decode_ids(ids[before[d] : before[d + 1]].tolist()) for d in odd.tolist()}
            skip = set(opens.tolist())
            parts = [own[d] if d in own else raw[edges[d] + (d in skip) : edges[d + 1]].tobytes() for d in range(len(counts))]
            return pa.array([p.decode() for p in parts], pa.string())
        keep = np.ones(total, bool)
        keep[edges[opens]] = False
        edges = edges - np.searchsorted(opens, np.arange(len(edges)), "left")
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[keep]))).cast(pa.string())


def coder(path: str) -> PieceCoder:
    """One coder per worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def _schema(df: DataFrame, *added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *added])


def encode_pieces(docs: DataFrame, text: str = "text", model: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` and the ids (array of int) of each whole text as the model's library gives them, without begin and end ids.

    A column of the name ``out`` is replaced, all others stay; every row gives one row.
    A null or empty text has no ids. Texts of any length are encoded whole; two different
    stretches of one worker with the same 64-bit hash would be mistaken for each other.
    """
    path, rows = model or public_model(), docs.drop(out)
    kept = rows.columns

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for i, j, ids, counts in own.encode_column(batch.column(text)):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), made], names=[*kept, out])

    return rows.mapInArrow(task, _schema(rows, f"`{out}` array<int>"))


def decode_pieces(df: DataFrame, ids: str = "ids", model: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` and the text of each array of ids as the model's library decodes it; a null array (or none) is empty.

    Null ids within an array are left out. Bytes that make no character become U+FFFD
    each; an id outside the vocabulary fails.
    """
    path, rows = model or public_model(), df.drop(out)
    rows = rows.withColumn(ids, F.filter(ids, lambda i: i.isNotNull()))
    kept = rows.columns

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            counts = np.array(pc.fill_null(pc.list_value_length(batch.column(ids)), 0)).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(counts)))
            values = batch.column(ids).flatten().to_numpy(zero_copy_only=False)
            for i, j in blocks(ends * 4, BLOCK_BYTES):
                made = own.decode_block(values[ends[i] : ends[j]], counts[i:j])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), made], names=[*kept, out])

    return rows.mapInArrow(task, _schema(rows, f"`{out}` string"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``: the ids' digest, and that of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_pieces(docs).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return decode_pieces(encoded).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
