"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (its documents in input order). As windows fill,
each queue's deficit counter grows by its target share of the tokens served; a queue
is served one quantum of ``grain`` tokens whenever its counter has reached a quantum,
and keeps the rest as deficit. Service ``m`` of source ``k`` so falls due at time
``(m + 1) / weight_k``; an exhausted queue drops out and the others carry on. How
many quanta each queue got before a given service follows from the weights alone, so
a partition starts with exactly the deficits its predecessors left, without running
them: counters carry over windows and partitions. Only tokens per (input partition,
source) are exchanged; ids never move.

Documents are cut where a quantum or a window ends, adjoining cuts of a document in
one window are one piece, and each window but the last is exactly full.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, staged
from .tokens import binary_column, encoder

WINDOW = 2048
GRAIN = 128
END_ID = 1
#: The query's target: natural shares to this power.
EXPONENT = 0.7
NULL_SOURCE = "\x00null"
_WEIGHT_SCALE = 1 << 20
_ROWS = 2000


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lean
def _tokenise(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """doc_id, source, part, before (tokens of the source earlier in this part), n, ids."""
    coder, part, before = encoder(path, kind), TaskContext.get().partitionId(), {}
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(i, _ROWS)
            ids, counts = coder.encode_column(batch.column("text"), end_id)
            starts = []
            for source, n in zip(batch.column("source").to_pylist(), counts.tolist(), strict=True):
                starts.append(before.get(source, 0))
                before[source] = starts[-1] + n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts), binary_column(ids, counts)], schema=schema)


def served_before(k: np.ndarray, m: np.ndarray, totals: np.ndarray, weights: np.ndarray, grain: int) -> np.ndarray:
    """Tokens that all queues were served before service ``m`` of source ``k``.

    Services fall due at ``(m + 1) / weight``; ties go to the smaller source index.
    """
    at = np.zeros(len(k), np.int64)
    own = weights[k]
    for j, (total, weight) in enumerate(zip(totals.tolist(), weights.tolist(), strict=True)):
        due = (m + 1) * weight
        count = np.where(j == k, m, np.where(j < k, due // own, -(-due // own) - 1))
        at += np.minimum(count * grain, total)
    return at


@lean
def _place(batches: Iterator[pa.RecordBatch], totals, weights, window: int, grain: int, code: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(i, _ROWS)
            k, begin, n = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("queue", "begin", "n"))
            first, last = begin // grain, (begin + n - 1) // grain
            count = last - first + 1
            doc = np.repeat(np.arange(len(k)), count)
            m = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
            lo, hi = np.maximum(begin[doc], m * grain), np.minimum((begin + n)[doc], (m + 1) * grain)
            at = served_before(k[doc], m, totals, weights, grain) + lo - m * grain
            # A quantum that crosses the end of a window is cut there (it crosses one at most).
            edge = (at // window + 1) * window
            cut = at + hi - lo > edge
            twice = np.repeat(np.arange(len(at)), 1 + cut)
            second = np.concatenate(([False], twice[1:] == twice[:-1]))
            size, doc = (hi - lo)[twice], doc[twice]
            part = (edge - at)[twice]
            at = np.where(second, edge[twice], at[twice])
            size = np.where(second, size - part, np.where(cut[twice], part, size))
            joined = np.zeros(len(at), bool)
            joined[1:] = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + size[:-1]) & (at[1:] % window != 0)
            head = np.flatnonzero(~joined)
            size = np.add.reduceat(size, head)
            doc, at = doc[head], at[head]
            ends = np.cumsum(size)
            base = np.cumsum(n) - n
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), code).astype("<u4")
            pieces = binary_column(ids, size)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("source").take(take), pa.array(ends - size - base[doc]), pa.array(size), pieces, pa.array(n[doc]), pa.array(at // window), pa.array(at % window)], schema=schema)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    kind: str = "dropped",
    weights: Mapping[str | None, float] | float | None = None,
    window: int = WINDOW,
    grain: int = GRAIN,
    end_id: int = END_ID,
    source: str = "source",
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> one row per piece: doc_id, source, start,
    length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    ``weights``: target token share by source (any scale; a source it lacks keeps its
    natural share, which is also the default for all), or an exponent for the natural
    shares (below 1 lifts small sources, whose queues then end sooner). A document is its ids and
    ``end_id``. Null or empty text: the end id alone. Null sources are one queue.
    Repeated rows are packed each on its own. Empty table: no rows. One total per
    source is held on the driver, nothing that grows with the documents; placing a piece
    takes a step for each source.
    """
    if window < 1 or not 1 <= grain <= window:
        raise ValueError("need 1 <= grain <= window")
    spark: SparkSession = docs.sparkSession
    path = tokenizer or word_bpe()
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    named = docs.select("doc_id", F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE)).alias("source"), "text")
    tokens = staged(named.mapInArrow(partial(_tokenise, path=path, kind=kind, end_id=end_id, schema=schema), "doc_id bigint, source string, part int, before bigint, n bigint, ids binary"), "token-ids")
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    totals = {r.source: r.tokens for r in by_part.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals)
    everything = sum(totals.values()) or 1
    natural = {s: totals[s] / everything for s in names}
    given = {NULL_SOURCE if s is None else s: w for s, w in weights.items()} if isinstance(weights, Mapping) else {s: x ** (1.0 if weights is None else weights) for s, x in natural.items()}
    share = np.array([given.get(s, natural[s]) for s in names], float)
    if len(share) and (share <= 0).any():
        raise ValueError("target weights must be positive")
    whole = np.maximum(1, np.round(share / max(share.sum(), 1e-300) * _WEIGHT_SCALE)).astype(np.int64)

    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queues = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, queue int")
    begins = by_part.withColumn("earlier", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).join(queues, "source").select("source", "part", "earlier", "queue")
    # A written table has a known size: joined by broadcast while it is small, so that ids stay where they are.
    begins = staged(begins, "queue-begins")
    placed = tokens.join(begins, ["source", "part"]).select("doc_id", "source", "queue", (F.col("earlier") + F.col("before")).alias("begin"), "n", "ids")
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    place = partial(_place, totals=np.array([totals[s] for s in names], np.int64), weights=whole, window=window, grain=grain, code=encoder(path, kind).code, schema=out)
    pieces = placed.mapInArrow(place, "doc_id bigint, source string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return pieces.withColumn("source", F.nullif("source", F.lit(NULL_SOURCE)))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``, mixed to their sources' shares to the power ``EXPONENT``."""
    return piece_digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=EXPONENT))
