"""Token files: ids in fixed-size blocks, transposed to planes, each plane compressed.

One file holds the documents of a stretch of the order, at most about ``FILE_IDS`` ids::

    "HBPF" u8 version
    chunks      each the zstandard frames of its planes, lowest plane first
    index       zstandard of: chunk table (u64 offset, u32 ids, u8 mode, u8 planes,
                u32 bytes of each plane), then the documents (validity, ids, counts)
    u32 shard, u32 place in the shard, u64 ids, u32 documents, u32 chunks, u32 bytes of index, "HBPE"

A block of ``BLOCK_IDS`` ids becomes byte planes (all lowest bytes, then the next) or
bit planes (bit 0 of every id, then bit 1 ...); planes that hold no set bit at the top
are left out. Each such image is the one binary value of a Parquet file, written by
Spark's own committer: any store that Spark reaches will do, and a retried task leaves
no trace.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, staged, staged_path
from .tokens import encoder

HEAD, FOOT = b"HBPF\x01", b"HBPE"
_TAIL = struct.Struct("<IIQIII4s")
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
END_ID = 2
LEVEL = 3
_CHUNK = np.dtype([("at", "<u8"), ("ids", "<u4"), ("mode", "u1"), ("planes", "u1")])
_ROWS = 1000


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of uint32 ids, lowest first."""
    if mode == "byte":
        planes = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
        return [p.tobytes() for p in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes])]
    planes = max(1, int(ids.max(initial=0)).bit_length())
    return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(planes)]


def from_planes(planes: list[bytes], count: int, mode: str) -> np.ndarray:
    ids = np.zeros(count, np.uint32)
    for k, plane in enumerate(planes):
        own = np.frombuffer(plane, np.uint8)
        if mode == "byte":
            ids |= own.astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(own, count=count).astype(np.uint32) << np.uint32(k)
    return ids


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, shard: int, place: int, mode: str = "byte", block: int = BLOCK_IDS) -> bytes:
    press = zstandard.ZstdCompressor(level=LEVEL)
    body, table, sizes, at = [HEAD], [], [], len(HEAD)
    for i in range(0, len(ids), block):
        own = ids[i : i + block].astype(np.uint32)
        planes = [press.compress(p) for p in to_planes(own, mode)]
        table.append((at, len(own), mode == "bit", len(planes)))
        sizes += [len(p) for p in planes]
        body += planes
        at += sum(map(len, planes))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = np.array(table, _CHUNK).tobytes() + np.array(sizes, "<u4").tobytes() + known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.astype("<u8").tobytes()
    index = press.compress(index)
    return b"".join([*body, index, _TAIL.pack(shard, place, len(ids), len(doc_ids), len(table), len(index), FOOT)])


def file_tail(image: bytes) -> tuple[int, int, int, int, int, int]:
    """(shard, place, ids, documents, chunks, bytes of index) of a file image."""
    *tail, foot = _TAIL.unpack(image[-_TAIL.size :])
    if foot != FOOT or image[: len(HEAD)] != HEAD:
        raise ValueError("not a token file")
    return tuple(tail)


def decode_file(image: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in this file, its ids) in order; one chunk is unpacked at a time."""
    _, _, _, docs, chunks, index_size = file_tail(image)
    end = len(image) - _TAIL.size
    unpress = zstandard.ZstdDecompressor()
    index = unpress.decompress(image[end - index_size : end])
    table = np.frombuffer(index, _CHUNK, chunks)
    at = table.nbytes
    sizes = np.frombuffer(index, "<u4", int(table["planes"].sum()), at)
    at += sizes.nbytes
    known = np.frombuffer(index, np.uint8, docs, at)
    doc_ids = np.frombuffer(index, "<i8", docs, at + docs)
    counts = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
    rest, taken, chunk, plane = np.zeros(0, np.uint32), 0, 0, 0
    for ok, doc_id, count in zip(known.tolist(), doc_ids.tolist(), counts.tolist(), strict=True):
        have = [rest]
        missing = count - len(rest)
        while missing > 0:
            c = table[chunk]
            own = sizes[plane : plane + int(c["planes"])].tolist()
            begin, planes = int(c["at"]), []
            for s in own:
                planes.append(unpress.decompress(image[begin : begin + s]))
                begin += s
            have.append(from_planes(planes, int(c["ids"]), "bit" if c["mode"] else "byte"))
            missing -= len(have[-1])
            chunk, plane = chunk + 1, plane + len(own)
        both = np.concatenate(have) if len(have) > 1 else rest
        yield (doc_id if ok else None), taken, both[:count]
        rest, taken = both[count:], taken + count


@lean
def _write(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int, mode: str, block: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    coder, shard, place = encoder(path, kind), TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    counts: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        image = encode_file(docs, np.concatenate(counts), np.concatenate(ids), shard, place, mode, block)
        return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["image"])

    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(i, _ROWS)
            own, count = coder.encode_column(batch.column("text"), end_id)
            docs += batch.column("doc_id").to_pylist()
            counts.append(count)
            ids.append(own)
            size += len(own)
            if size >= file_ids:
                yield close()
                place, size = place + 1, 0
                for held in (docs, counts, ids):
                    held.clear()
    if docs:
        yield close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, kind: str = "leading", end_id: int = END_ID, mode: str = "byte", block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Write (doc_id, text) in ascending doc_id order (nulls first) as token files under ``path``.

    Rows of one doc_id are ordered by a hash of their text, which also lets a much
    repeated id spread over files. Null text is empty: the end id alone.
    """
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    images = ranged.mapInArrow(partial(_write, path=tokenizer or byte_bpe(), kind=kind, end_id=end_id, mode=mode, block=block, file_ids=file_ids), "image binary")
    images.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


@lean
def _documents(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("image"):
            image = value.as_py()
            shard, place, *_ = file_tail(image)
            rows: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                columns = [[shard] * len(rows), [place] * len(rows), *zip(*rows, strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

            for doc_id, before, ids in decode_file(image):
                rows.append((doc_id, before, len(ids), ids.astype("<u4").tobytes()))
                held += len(ids)
                if held > 1 << 20:
                    yield flush()
                    rows, held = [], 0
            if rows:
                yield flush()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), shard, place, before (ids earlier in the file)."""
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    files = spark.read.schema("image binary").parquet(path)
    return files.mapInArrow(partial(_documents, schema=schema), "shard bigint, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids binary")


def document_starts(docs: DataFrame) -> DataFrame:
    """``docs`` (as read, with shard, place, before, n_tokens) with ``start``: ids of all documents before it.

    One total a file is put in order: within its shard, then over shards.
    """
    files = docs.groupBy("shard", "place").agg(F.sum("n_tokens").alias("ids"))
    shards = files.groupBy("shard").agg(F.sum("ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("own", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(shards, "shard").select("shard", "place", (F.col("shard_start") + F.col("own")).alias("file_start"))
    return docs.join(files, ["shard", "place"]).withColumn("start", F.col("file_start") + F.col("before")).drop("file_start")


def op8_bit_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, from the files that all of ``documents`` were written to."""
    path = staged_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    digests = staged(read_token_files(spark, path).select("shard", "place", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-digests")
    return document_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")
