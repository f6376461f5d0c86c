"""Fill-in-the-middle: a text's units are cut at two drawn places and the parts moved around.

A document's units (lines by default) are prefix, middle and suffix; the transformed
text gives the prefix and the suffix before the middle, each behind its marker, so that a
model that reads from left to right learns to fill gaps. The draws are the first 32-bit
groups of ``sha256("<seed>:<doc_id>")``: the same on every run, machine and partitioning.

A task works on whole documents a block at a time, straight on the UTF-8 bytes of the
Arrow column: a byte's class comes from a table, a unit begins where the classes of
adjacent bytes say so, cumulative sums that start anew with each document number units
and code points, and one binary search finds the cuts of all documents of the block.
Arrow then puts the parts together; no Python object is made for a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .words import blocks, utf8

BLOCK_BYTES = 1 << 20
_ENDS_LINE, _BEGINS_CHARACTER = 1, 2
_CLASS = np.array([(_ENDS_LINE if b == 0x0A else 0) | (_BEGINS_CHARACTER if b & 0xC0 != 0x80 else 0) for b in range(256)], np.uint8)
_ADDED = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_DRAW = "harrow_draw"


@dataclass(frozen=True)
class InfillOptions:
    """``rate`` and ``spm_rate`` are per cent; ``unit`` is ``line`` or ``character``.

    Markers must differ, none may begin another, and a marker's first character may
    occur in no marker a second time: then a marker is never read across the seam of a
    part and a marker, and outputs can be taken apart.
    """

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    unit: str = "line"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in ("line", "character"):
            raise ValueError(f"unknown unit {self.unit!r}")
        marks = [self.prefix, self.suffix, self.middle]
        if not all(marks) or any(a is not b and b.startswith(a) for a in marks for b in marks) or any(m[0] in n[1:] for m in marks for n in marks):
            raise ValueError(f"markers {marks} can't be told apart from each other and the text around them")


def _up_to(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of what lies before each place, of running sums."""
    return np.where(at > 0, sums[np.maximum(at, 1) - 1], 0).astype(np.int64) if len(sums) else np.zeros(len(at), np.int64)


def cut_places(raw: np.ndarray, edges: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(units, first cut, second cut, code points of prefix, of middle) of all documents of a block.

    ``edges`` are the documents' byte offsets in ``raw``; cuts are byte places there.
    """
    kinds = _CLASS[raw]
    if unit == "line":
        begins = np.zeros(len(raw), bool)
        begins[1:] = kinds[:-1] & _ENDS_LINE != 0
        begins[edges[:-1][edges[1:] > edges[:-1]]] = True
    else:
        begins = kinds & _BEGINS_CHARACTER != 0
    wide = np.int32 if len(raw) < 1 << 31 else np.int64
    sums = np.cumsum(begins, dtype=wide)
    before = _up_to(sums, edges)
    n = np.diff(before)
    drawn = draws[:, :2] % (n + 1)[:, None]
    # The unit after the last one begins where the next document with any text does: at this one's end.
    first, second = (np.searchsorted(sums, (before[:-1] + k + 1).astype(wide), "left") for k in (drawn.min(axis=1), drawn.max(axis=1)))
    del sums, begins
    sums = np.cumsum(kinds & _BEGINS_CHARACTER != 0, dtype=wide)
    start, a, b = (_up_to(sums, at) for at in (edges[:-1], first, second))
    return n, first, second, a - start, b - a


def _block(raw: np.ndarray, edges: np.ndarray, draws: np.ndarray, options: InfillOptions) -> list[pa.Array]:
    n, first, second, prefix_chars, middle_chars = cut_places(raw, edges, draws, options.unit)
    docs, data = len(n), pa.py_buffer(raw)
    text = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), data)
    thirds = np.append(np.stack((edges[:-1], first, second), axis=1).ravel(), edges[-1:]).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(3 * docs, pa.py_buffer(thirds), data)
    prefix, middle, suffix = (parts.take(pa.array(np.arange(docs) * 3 + k)) for k in range(3))
    mark = {k: pa.scalar(getattr(options, k), pa.large_string()) for k in ("prefix", "suffix", "middle")}
    nothing = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle, nothing)
    spm = pc.binary_join_element_wise(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle, nothing)
    plain = pa.array((n == 0) | (draws[:, 2] % 100 >= options.rate))
    for m in mark.values():
        plain = pc.or_(plain, pc.match_substring(text, m.as_py()))
    turned = pa.array(draws[:, 3] % 100 < options.spm_rate)
    form = pc.if_else(plain, "plain", pc.if_else(turned, "spm", "psm"))
    output = pc.if_else(plain, text, pc.if_else(turned, spm, psm))
    none = pa.scalar(None, pa.int64())
    return [pa.array(n), form, pc.if_else(plain, none, pa.array(prefix_chars)), pc.if_else(plain, none, pa.array(middle_chars)), output.cast(pa.string())]


def fill_in_middle(docs: DataFrame, options: InfillOptions | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` and n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Columns of these names are replaced, all others stay; every row gives one row, in no
    order. A null text is empty. Empty texts, texts that hold a marker and those beyond
    ``rate`` stay plain: the output is the text, and the counts of code points are null.
    Rows of one id are cut by the same draws; a null id draws as an empty one. Texts of
    any length are cut whole; a document is held in memory with some ten times its bytes.
    """
    options = options or InfillOptions()
    added = [f.split()[0] for f in _ADDED.split(", ")]
    kept = [c for c in docs.columns if c not in added and c != _DRAW]
    seed = F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(*kept, F.unhex(F.sha2(seed, 256)).alias(_DRAW))

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            hashes = np.frombuffer(b"".join(batch.column(_DRAW).to_pylist()), ">u4").reshape(-1, 8)
            for i, j in blocks(offsets, BLOCK_BYTES):
                raw, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                made = _block(raw, edges, hashes[i:j].astype(np.int64), options)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), *made], names=[*kept, *added])

    return rows.mapInArrow(task, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), _ADDED]))


def restored(output: Column | str = "output", form: Column | str = "form", options: InfillOptions | None = None) -> Column:
    """The text that was transformed, from the output and its form alone."""
    options = options or InfillOptions()
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    marks = "|".join("\\Q" + m.replace("\\E", "\\E\\\\E\\Q") + "\\E" for m in (options.prefix, options.suffix, options.middle))
    part = F.split(output, marks)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def restore(output: str, form: str, options: InfillOptions | None = None) -> str:
    """``restored`` of one value."""
    options = options or InfillOptions()
    if form == "plain":
        return output
    _, a, b, middle = re.split("|".join(map(re.escape, (options.prefix, options.suffix, options.middle))), output)
    return a + middle + b if form == "psm" else b + middle + a


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: the outputs' digests, and those of the texts that come back from them."""
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))
