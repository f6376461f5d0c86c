"""Short codes for vectors: each part of a vector becomes the index of its nearest codebook entry.

Components are integers ``floor(scale * x)``, so sums, means and ties are exact and the
same however rows are dealt out. The vectors are packed once into blocks, one row of
integers a dimension, and written to the shared folder. Each round is one
``RDD.treeAggregate`` over these blocks: a task adds up squared distances dimension by
dimension, takes the nearest entries, and adds the parts to int64 tensors of sums and
counts with ``np.add.at``; the tensors (8 KB at 64 dimensions and 16 entries) merge in a
tree, so neither the driver nor a task holds more than a few, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 4096
#: Beyond, components count as this: squared distances over 64 dimensions then fit in 63 bits.
LARGEST = 1 << 27
DEPTH = 3


@dataclass(frozen=True)
class Codebooks:
    """Entries by part; parts are ``bounds[p] .. bounds[p + 1]`` of the dimensions."""

    entries: tuple[np.ndarray, ...]
    bounds: tuple[int, ...]
    scale: int

    @property
    def width(self) -> int:
        return self.bounds[-1]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        flat = [str(x) for part in self.entries for x in part.ravel().tolist()]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, none of them null, NaN or infinite."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: F.coalesce((x.cast("double") > float("-inf")) & (x.cast("double") < float("inf")), F.lit(False)))
    return df.where(v.isNotNull() & (F.size(v) > 0) & sound)


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """(width, rows): the vectors' integer components, a row for each dimension."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.ascontiguousarray(np.clip(np.floor(flat * scale), -LARGEST, LARGEST).T).astype(np.int64)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each column of ``part`` (dimension, row) to the entries of ``book``; ties to the lower index."""
    far = np.zeros((len(book), part.shape[1]), np.int64)
    for own, centre in zip(part, book.T, strict=True):
        step = own[None, :] - centre[:, None]
        step *= step
        far += step
    code = far.argmin(axis=0)
    return code, far[code, np.arange(part.shape[1])]


def _packed(vectors: DataFrame, vector: str, width: int, scale: int) -> DataFrame:
    """(kind, data): blocks of at most ``BLOCK_ROWS`` vectors, dimension by dimension, in the narrowest integers that hold them."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                block = integers(batch.column(0).slice(i, BLOCK_ROWS), width, scale)
                kind = np.promote_types(np.min_scalar_type(block.min()), np.min_scalar_type(block.max())).newbyteorder("<") if block.size else np.dtype("<i2")
                kind = kind if kind.kind == "i" else np.dtype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([kind.str]), pa.array([block.astype(kind).tobytes()], pa.binary())], names=["kind", "data"])

    return vectors.select(vector).mapInArrow(task, "kind string, data binary")


def _summed(books: Codebooks):
    """The step of a round: a block's parts join the sums and counts of their nearest entries."""

    def add(total, row):
        if total is None:
            total = [np.zeros_like(b) for b in books.entries], [np.zeros(len(b), np.int64) for b in books.entries]
        block = np.frombuffer(row[1], row[0]).reshape(books.width, -1).astype(np.int64)
        for p, book in enumerate(books.entries):
            part = block[books.bounds[p] : books.bounds[p + 1]]
            code, _ = nearest(part, book)
            for j, own in enumerate(part):
                np.add.at(total[0][p][:, j], code, own)
            np.add.at(total[1][p], code, 1)
        return total

    return add


def _merged(a, b):
    if a is None or b is None:
        return b if a is None else a
    for k in range(2):
        for own, other in zip(a[k], b[k], strict=True):
            own += other
    return a


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all whole vectors; None without any.

    A part's book starts as that part of the vectors with the smallest ids (nulls last;
    rows of one id in the order of their vectors), fewer than ``entries`` if there are
    fewer rows. Vectors of another length than the first one are left out. Part ``p``
    of ``d`` dimensions is ``p * d // parts`` up to ``(p + 1) * d // parts``. Entries
    that no part chose stay as they are.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    rows = whole_vectors(vectors, vector).select(id_col, vector)
    order = [F.col(id_col).asc_nulls_last(), vector]
    first = rows.orderBy(*order).limit(entries).collect()
    if not first:
        return None
    width = len(first[0][1])
    rows = rows.where(F.size(vector) == width)
    if any(len(r[1]) != width for r in first):
        first = rows.orderBy(*order).limit(entries).collect()
    start = integers(pa.array([list(map(float, r[1])) for r in first], pa.list_(pa.float64())), width, scale)
    bounds = tuple(p * width // parts for p in range(parts + 1))
    books = Codebooks(tuple(np.ascontiguousarray(start[a:b].T) for a, b in zip(bounds, bounds[1:], strict=False)), bounds, scale)
    blocks = staged(_packed(rows, vector, width, scale), "vector-blocks").rdd
    for _ in range(rounds):
        sums, counts = blocks.treeAggregate(None, _summed(books), _merged, DEPTH)
        books = Codebooks(tuple(np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for s, n, b in zip(sums, counts, books.entries, strict=True)), bounds, scale)
    return books


def encode_vectors(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` with a whole vector of the books' length, with code and error.

    ``code`` has two hex digits a part, ``error`` is the squared distance (of integer
    components) to what the code stands for. Columns of these names are replaced.
    """
    kept = [c for c in df.columns if c not in ("code", "error")]
    rows = whole_vectors(df.select(*kept), vector).where(F.size(vector) == books.width)
    digits = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), "S2")

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(i, BLOCK_ROWS)
                block = integers(batch.column(vector), books.width, books.scale)
                found = [nearest(block[a:b], book) for a, b, book in zip(books.bounds, books.bounds[1:], books.entries, strict=False)]
                code = np.stack([digits[c] for c, _ in found], axis=1).view(f"S{2 * len(found)}").ravel()
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(code.astype(str)), pa.array(error)], names=[*kept, "code", "error"])

    return rows.mapInArrow(task, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "code string", "error bigint"]))


def decode_vectors(df: DataFrame, books: Codebooks, code: str = "code", out: str = "decoded") -> DataFrame:
    """``df`` with the vector (array of doubles) that each code stands for: the middles of the entries' integer steps."""
    table = [[[(x + 0.5) / books.scale for x in entry] for entry in part] for part in books.entries]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return df.withColumn(out, F.concat(*(F.lit(part)[at(p)] for p, part in enumerate(table) if part[0])))


def with_label_error(encoded: DataFrame, label: str = "label") -> DataFrame:
    """``encoded`` (read twice) with label_error: the errors summed over equal labels, nulls together; null beyond a long."""
    own = F.struct(label).alias("harrow_label")
    totals = encoded.groupBy(own).agg(F.try_sum("error").alias("label_error"))
    return encoded.drop("label_error").withColumn("harrow_label", own).join(small(totals, 200), "harrow_label").drop("harrow_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``embeddings`` (repeated ids give a row each)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = fit_codebooks(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    encoded = staged(encode_vectors(vectors, books).drop("embedding"), "vector-codes")
    return with_label_error(encoded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
