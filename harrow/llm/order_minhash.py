"""Order MinHash fingerprints: sketches of a text that follow its edit distance.

Every 8-character piece of a text is numbered by its earlier occurrences, and the
numbered piece hashed. Each of 64 independent permutations selects the two pieces
that it puts first; they are put back in text order, and their pair is hashed into
one 32-bit component. Unlike a MinHash component it changes when pieces change
places. The likeness of two fingerprints is the share of equal components: 1 for
equal texts, near 0 for unrelated ones.

A text shorter than a piece is one piece; the empty text has the fingerprint ``-``
and is like nothing but itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, small, staged
from .words import mix

PIECE = 8
PERMUTATIONS = 64
TAKEN = 2
EMPTY = "-"
#: Code points of a text that one block of permuted values covers.
SPAN = 2048
#: Code points of the texts that are compared at once.
BLOCK_CHARS = 1 << 16
#: Bytes of text that a stretch of documents is meant to hold.
STRETCH_BYTES = 1 << 26
#: Equal rows (id and text) from here on may be dealt to several stretches.
HOT_ROWS = 10_000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_ODD = mix(np.arange(1, 65, dtype=np.uint64) * _STEP) | _U(1)
_FLIP = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) >> _U(32)).astype(np.uint32)[:, None]
_TIMES = ((mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)) >> _U(32)).astype(np.uint32) | np.uint32(1))[:, None]
_LAST = np.uint32(0xFFFFFFFF)
_ROW = np.arange(PERMUTATIONS)
_SALT = _ROW.astype(np.uint64) * _STEP

_ABSENT = _U(0xFFFFFFFFFFFFFFFF)
_KNOWN_BITS = 16


def piece_hashes(codes: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each run of ``piece`` code points within each of the texts in turn; a shorter text is one run."""
    wide = codes.astype(np.uint64) + _U(1)
    ends = np.cumsum(sizes)
    count = np.where(sizes >= piece, sizes - piece + 1, (sizes > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(offsets[-1]), np.uint64)
    if len(wide) >= piece:
        m = len(wide) - piece + 1
        rolled, term = wide[:m] * _ODD[0], np.empty(m, np.uint64)
        for k in range(1, piece):
            np.multiply(wide[k : m + k], _ODD[k], out=term)
            rolled += term
        long = sizes >= piece
        starts = np.zeros(len(wide), bool)  # where a run begins: not in a text's last positions
        for begin, n in zip((ends - sizes)[long].tolist(), count[long].tolist(), strict=True):
            starts[begin : begin + n] = True
        out[np.repeat(long, count)] = mix(rolled[starts[:m]])
    for d in np.flatnonzero((sizes > 0) & (sizes < piece)).tolist():
        own = wide[ends[d] - sizes[d] : ends[d]]
        out[offsets[d]] = mix((own * _ODD[: len(own)]).sum(keepdims=True) + _U(len(own)))[0]
    return out, offsets


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes of one text with the number of the same piece's earlier occurrences mixed in."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return hashes
    # Only pieces that may be repeated (by their leading bits) are put in order with their places.
    known = np.zeros(1 << _KNOWN_BITS, bool)
    known[twice >> _U(64 - _KNOWN_BITS)] = True
    maybe = np.flatnonzero(known[hashes >> _U(64 - _KNOWN_BITS)])
    order = maybe[np.argsort(hashes[maybe], kind="stable")]
    own = hashes[order]
    fresh = np.concatenate(([True], own[1:] != own[:-1]))
    run = np.arange(len(own)) - np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    out = hashes.copy()
    again = ~fresh
    out[order[again]] = mix(own[again] + run[again].astype(np.uint64) * _STEP)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts in turn, number of each)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def items_of(texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(items, offsets): the numbered pieces of each text, in turn."""
    hashes, offsets = piece_hashes(*_codes(texts), piece)
    own = [numbered(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return (np.concatenate(own) if own else hashes), offsets


def select(items: np.ndarray, begin: np.ndarray, end: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """(stretches, 2, permutations): the two items of each stretch that each permutation puts first.

    Given as rank << 32 | position, counted from ``origin``; ties go to the earlier item,
    and an absent one is all ones.
    """
    out = np.full((len(begin), TAKEN, PERMUTATIONS), _ABSENT)
    low = (items >> _U(32)).astype(np.uint32)
    room = np.empty(PERMUTATIONS * SPAN, np.uint32)
    # With its usual buffer numpy copies rows shorter than that before it works on them: three times slower.
    usual = np.setbufsize(16)
    for s, (first, last, base) in enumerate(zip(begin.tolist(), end.tolist(), origin.tolist(), strict=True)):
        for i in range(first, last, SPAN):
            m = min(SPAN, last - i)
            flat = room[: PERMUTATIONS * m]
            ranks, row = flat.reshape(PERMUTATIONS, m), _ROW * m
            np.bitwise_xor(low[i : i + m], _FLIP, out=ranks)
            np.multiply(ranks, _TIMES, out=ranks)
            own = np.full((1, TAKEN, PERMUTATIONS), _ABSENT) if i > first else out[s : s + 1]
            for k in range(min(TAKEN, m)):
                at = ranks.argmin(axis=1)
                cell = at + row
                own[0, k] = (flat[cell].astype(np.uint64) << _U(32)) + (at + (i - base)).astype(np.uint64)
                flat[cell] = _LAST
            if i > first:
                out[s] = both_first(out[s : s + 1], own)[0]
    np.setbufsize(usual)
    # A piece whose own rank is the last one may be named twice: once is enough.
    out[:, 1][out[:, 1] == out[:, 0]] = _ABSENT
    return out


def both_first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The choice among two stretches together."""
    later = np.minimum(np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 1], b[:, 1]))
    return np.stack((np.minimum(a[:, 0], b[:, 0]), later), axis=1)


def components_of(items: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> list[np.ndarray | None]:
    """For each text one hash for each permutation, of its pieces in text order; None for no pieces."""
    if not len(items):
        return [None] * (len(offsets) - 1)
    empty = offsets[1:] == offsets[:-1]
    places = (chosen & _U(0xFFFFFFFF)).astype(np.int64)
    alone = chosen[:, 1] == _ABSENT
    one, two = places[:, 0], np.where(alone, places[:, 0], places[:, 1])
    base = offsets[:-1, None]
    at = [np.where(empty[:, None], 0, base + x) for x in (np.minimum(one, two), np.maximum(one, two))]
    pairs = mix(items[at[0]] * _ODD[10] + items[at[1]] * _ODD[11] + (~alone).astype(np.uint64) + _SALT)
    return [None if none else own for none, own in zip(empty.tolist(), (pairs >> _U(32)).astype(np.uint32), strict=True)]


def sketch(text: str, piece: int = PIECE) -> np.ndarray | None:
    """The 64 components, or None for an empty text."""
    return sketches([text], piece)[0]


def sketches(texts: list[str], piece: int = PIECE) -> list[np.ndarray | None]:
    items, offsets = items_of(texts, piece)
    return components_of(items, offsets, select(items, offsets[:-1], offsets[1:], offsets[:-1]))


def sketches_of_edits(texts: list[str], edited: list[str], same: list[int], piece: int = PIECE) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
    """Sketches of the texts and of their edited texts, whose first ``same`` code points are equal: their pieces are permuted once."""
    (one, at_one), (two, at_two) = items_of(texts, piece), items_of(edited, piece)
    shared = np.maximum(0, np.array(same, np.int64) - piece + 1)
    middle = at_one[:-1] + shared
    first = select(one, at_one[:-1], middle, at_one[:-1])
    own = both_first(first, select(one, middle, at_one[1:], at_one[:-1]))
    other = both_first(first, select(two, at_two[:-1] + shared, at_two[1:], at_two[:-1]))
    return components_of(one, at_one, own), components_of(two, at_two, other)


def shown(components: np.ndarray | None) -> str:
    return EMPTY if components is None else components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


@lean
def fingerprint(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        for text in batch.column("harrow_text"):
            prints.append(shown(sketch(text.as_py(), piece)))
        names = [n for n in batch.schema.names if n != "harrow_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(prints, pa.string())], names=[*names, "fingerprint"])


def with_fingerprint(docs: DataFrame, keep: list[str], piece: int = PIECE, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fingerprint`` (one named so is replaced).

    Null text counts as empty. Rows stay as they are, repeated ones too; no rows give none.
    """
    keep = [c for c in keep if c != "fingerprint"]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("harrow_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "harrow_text")
    return rows.mapInArrow(partial(fingerprint, piece=piece), f"{schema + ', ' if schema else ''}fingerprint string")


def _order(key: tuple) -> tuple:
    return key[0] is not None, key[0] or 0, key[1]


_LANDMARKS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])


@lean
def _landmarks(batches: Iterator[pa.RecordBatch], bar: int) -> Iterator[pa.RecordBatch]:
    """Of a range's keys in order: the first, those of more than ``bar`` rows (with their number), and what follows these."""
    found: list[tuple] = []
    run, n, follows = None, 0, True

    def closed() -> None:
        if n > bar or follows and n:
            found.append((*run, n if n > bar else None))

    for batch in batches:
        for key in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), strict=True):
            if key == run:
                n += 1
                continue
            closed()
            run, n, follows = key, 1, run is None or n > bar
    closed()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _LANDMARKS, strict=True)], schema=_LANDMARKS)


class Stretches:
    """Stretches of the order of keys (doc_id, h), by their first keys.

    Stretch ``i`` has the numbers from ``base[i]`` on: one, unless it is a single much
    repeated key, which has ``parts[i]``. Tasks get it as a broadcast value of 25 bytes
    a stretch, and find places in it by binary search.
    """

    def __init__(self, cuts: list[tuple], parts: list[int]):
        cuts = [*zip(*sorted(zip(cuts, parts, strict=True), key=lambda c: _order(c[0])), strict=True)]
        self.nulls = sum(k[0] is None for k in cuts[0])
        self.ids = np.array([k[0] or 0 for k in cuts[0]], np.int64)
        self.hashes = np.array([k[1] for k in cuts[0]], np.int64)
        self.parts = np.array(cuts[1], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.parts)))

    @property
    def numbers(self) -> int:
        return int(self.base[-1])

    def place(self, ids: pa.Array, hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last cut at or below each key, whether it is that cut); keys below all cuts have the first."""
        void = ids.is_null().to_numpy(zero_copy_only=False)
        own, h = ids.fill_null(0).to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        known = self.ids[self.nulls :]
        low, high = (np.where(void, other, self.nulls + np.searchsorted(known, own, side)) for side, other in (("left", 0), ("right", self.nulls)))
        at = low.copy()
        # Where cuts share the id, their hashes decide.
        shared = np.flatnonzero(high > low)
        if len(shared):
            shared = shared[np.argsort(low[shared], kind="stable")]
            bounds = np.flatnonzero(np.diff(low[shared], prepend=-1, append=-1))
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = shared[i:j]
                at[rows] += np.searchsorted(self.hashes[low[rows[0]] : high[rows[0]]], h[rows], "right")
        at = np.maximum(at - 1, 0)
        return at, (self.ids[at] == own) & (self.hashes[at] == h) & ((at < self.nulls) == void)

    def closes(self) -> pa.Table:
        """(s, number): the numbers after whose rows the first key of stretch ``s`` comes: its own parts but the last, and the last of the stretch before."""
        s = np.repeat(np.arange(len(self.parts)), self.parts)
        number = np.arange(self.numbers)
        last = np.concatenate((s[1:] != s[:-1], [True]))
        return pa.table({"s": np.where(last, (s + 1) % len(self.parts), s).astype(np.int32), "number": number.astype(np.int32)})


def stretches(keys: DataFrame, total: int, parts: int, hot_rows: int) -> Stretches:
    """About ``parts`` stretches of ``keys(doc_id, h)``, from one pass over them in order.

    The first key of each range reaches the driver, and the keys of more than a
    range's rows with what follows them.
    """
    bar = max(hot_rows, math.ceil(total / parts))
    ranges = keys.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    found = ranges.mapInArrow(partial(_landmarks, bar=bar), "doc_id bigint, h bigint, n bigint").collect()
    return Stretches([(r.doc_id, r.h) for r in found], [math.ceil(r.n / bar) if r.n else 1 for r in found])


@lean
def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each stretch's first key that this task meets."""
    seen: set[int] = set()
    for batch in batches:
        at = []
        for i, s in enumerate(batch.column("s").to_pylist()):
            if s not in seen:
                seen.add(s)
                at.append(i)
        if at:
            yield batch.take(pa.array(at)) if len(at) < batch.num_rows else batch


def neighbours(docs: DataFrame, stretch_bytes: int = STRETCH_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(number, ahead, doc_id, text): rows in stretches of the ascending order, one partition
    each, every stretch closed by the row that comes after it (``ahead``).

    The order is (doc_id, hash of the text), nulls first. The slim table of these keys
    gives the stretches, so whole texts are shuffled once. A key repeated beyond
    ``hot_rows`` is dealt to several stretches: its rows are equal, so any of them
    may follow any other.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = staged(rows.select("doc_id", "h", F.octet_length("text").alias("bytes")), "order-keys")
    total, size = keys.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = max(shuffle_partitions(spark), math.ceil((size or 0) / stretch_bytes))
    if not total:
        return rows.select(F.lit(0).alias("number"), F.lit(False).alias("ahead"), "doc_id", "text")
    cut = stretches(keys.drop("bytes"), total, parts, hot_rows)
    sent = spark.sparkContext.broadcast(cut)

    @F.arrow_udf("int")
    def number(doc_id: pa.Array, h: pa.Array, spread: pa.Array) -> pa.Array:
        at, _ = sent.value.place(doc_id, h)
        return pa.array(sent.value.base[at] + spread.to_numpy(zero_copy_only=False) % sent.value.parts[at], pa.int32())

    @F.arrow_udf("int")
    def begins(doc_id: pa.Array, h: pa.Array) -> pa.Array:
        at, exact = sent.value.place(doc_id, h)
        return pa.array(at, pa.int32(), mask=~exact)

    # A row of each first key, then one for each number that it closes.
    first = rows.withColumn("s", begins("doc_id", "h")).where("s is not null").select("s", "doc_id", "h", "text")
    first = first.mapInArrow(_one_each, first.schema).dropDuplicates(["s"])
    closes = small(spark.createDataFrame(cut.closes()), 64)
    ahead = first.join(closes, "s").select("number", F.lit(True).alias("ahead"), "doc_id", "h", "text")
    dealt = rows.select(number("doc_id", "h", F.xxhash64(F.monotonically_increasing_id())).alias("number"), F.lit(False).alias("ahead"), "doc_id", "h", "text")
    return dealt.unionByName(ahead).repartitionById(cut.numbers, "number").sortWithinPartitions("number", "ahead", "doc_id", "h").drop("h")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


@lean
def _compare(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Rows come by number, the row ahead last; a block of rows is compared when its successor is seen."""
    held: list[tuple[int, int | None, str]] = []  # a run of one number, whose last row waits for its successor
    size = 0

    def compared() -> pa.RecordBatch:
        texts = [t for _, _, t in held]
        same = [len(t) - len(t) // 4 for t in texts[:-1]]
        edited = [t[:n] + after[: len(t) - n] for t, n, after in zip(texts, same, texts[1:], strict=False)]
        own, other = sketches_of_edits(texts[:-1], edited, same, piece)
        following = own[1:] + [sketch(texts[-1], piece)]
        columns = [
            [i for _, i, _ in held[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            [shown(x) for x in own], [shown(x) for x in other], [likeness(x, y) for x, y in zip(own, other, strict=True)], [likeness(x, y) for x, y in zip(own, following, strict=True)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("number", "doc_id", "text")), strict=True):
            if held and held[-1][0] != row[0]:
                if len(held) > 1:
                    yield compared()
                held, size = [], 0
            held.append(row)
            size += len(row[2])
            if size > BLOCK_CHARS and len(held) > 1:
                yield compared()
                held, size = held[-1:], len(row[2])
    if len(held) > 1:
        yield compared()


def compare_with_edits(docs: DataFrame, piece: int = PIECE, stretch_bytes: int = STRETCH_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter (``n // 4`` code points) replaced
    by the start of the next document's, in ascending doc_id (null ids first, equal ids
    by the 64-bit hash of their text; after the last comes the first). Null text is
    empty. A single row is its own successor; repeated rows follow one another. Empty
    table: no rows. Other columns are ignored.
    """
    return neighbours(docs, stretch_bytes, hot_rows).mapInArrow(partial(_compare, piece=piece), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``, by ``compare_with_edits``."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
