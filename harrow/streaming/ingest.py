"""Ingestion: hash check, chunking, embedding, replacement; in one batch or as a stream."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import HarrowError, IndexError_, SourceError
from ..functions.text import embedding_text
from ..operators.chunking import TokenCounter, chunk_documents, empty_documents, word_counter
from ..operators.clustering import assign
from ..operators.index import CHUNK_SCHEMA, hashed_embedding, with_content_hash
from ..operators.store import IndexStore
from ..options import ChunkingOptions
from ..sources.corpus import DOCUMENT_SCHEMA
from ..staging import stage

log = logging.getLogger("harrow")
#: An id and a hash take some 200 bytes in a broadcast table.
BROADCAST_KEYS = 100_000

#: Documents that make one segment of the index; a group that fails leaves the others alone.
FLUSH_DOCUMENTS = 1_000_000
#: Failed documents that a report names; ``failed`` counts all.
FAILURES_SHOWN = 1_000


class Embedder(Protocol):
    """Makes vectors of (id, text) tables; a model may treat queries otherwise than documents."""

    def documents(self, texts: DataFrame, id_col: str) -> DataFrame: ...

    def queries(self, texts: DataFrame, id_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """The offline embedder: signed feature hashing, the same for both."""

    dimension: int = 64

    def documents(self, texts: DataFrame, id_col: str) -> DataFrame:
        return hashed_embedding(texts, id_col, "text", self.dimension)

    def queries(self, texts: DataFrame, id_col: str) -> DataFrame:
        return hashed_embedding(texts, id_col, "text", self.dimension)


@dataclass
class IngestionReport:
    seen: int = 0
    unchanged: int = 0
    indexed: int = 0
    chunks: int = 0
    failed: int = 0
    broken: int = 0
    failures: dict[str, str] = field(default_factory=dict)
    elapsed_s: float = 0.0

    def add(self, chunks: int, lost: DataFrame, broken: bool = False) -> None:
        """A group's chunks, and its failed documents (doc_id, reason); ``broken``: all of them, by no fault of theirs."""
        self.chunks += chunks
        failed = lost.count()
        self.failed += failed
        self.broken += failed if broken else 0
        room = FAILURES_SHOWN - len(self.failures)
        self.failures.update({r.doc_id: r.reason for r in lost.orderBy("doc_id").limit(room).collect()})

    def check(self) -> None:
        """A stream must not go on after groups that could not be written: their files won't come again."""
        if self.broken:
            raise IndexError_(f"{self.broken} documents could not be written: {next(iter(self.failures.values()))}")


def latest_changes(hashed: DataFrame, held: DataFrame | Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(keys of the corpus, rows of ``hashed`` that are new or changed).

    Of a repeated id the largest hash counts, and one row of it. Only ids and hashes are
    shuffled until the changed ones are known; texts of unchanged documents never are.
    ``held``: (doc_id, content_hash) of what is there, or what gives that for keys.
    """
    keys = stage(hashed.groupBy("doc_id").agg(F.max("content_hash").alias("content_hash")))
    held = held(keys) if callable(held) else held
    changed = stage(keys.join(held, ["doc_id", "content_hash"], "left_anti"))
    wanted = F.broadcast(changed) if changed.count() <= BROADCAST_KEYS else changed
    return keys, hashed.join(wanted, ["doc_id", "content_hash"], "left_semi").dropDuplicates(["doc_id"])


def ingest(
    store: IndexStore, docs: DataFrame, options: ChunkingOptions | None = None, count: TokenCounter = word_counter, embed: Embedder | None = None, flush_documents: int = FLUSH_DOCUMENTS, batch: tuple[str, int] | None = None
) -> IngestionReport:
    """Index what is new or changed in ``docs`` (doc_id, title, text, source_uri, metadata).

    Unchanged documents are skipped by hash. A document without content fails and keeps
    its old chunks; documents that left the corpus stay. Of a repeated id the row with
    the largest hash is taken. Chunks get the cluster of their nearest centroid if
    there is a model. Changed documents are written in groups of about
    ``flush_documents``, a segment each; where a group's embedding or writing fails, at
    any step, its documents are reported as failed, keep what they had, and are new
    again in the next run. The report names at most ``FAILURES_SHOWN`` of them.
    Afterwards segments of like size are merged.

    ``batch`` (a stream's name, the number of a batch): a batch that is wholly in the
    index already is not looked at again; one that broke off goes on where it did.
    """
    begun = time.monotonic()
    if missing := [c for c in DOCUMENT_SCHEMA.fieldNames() if c not in docs.columns]:
        raise SourceError(f"documents lack {', '.join(missing)}")
    store.ensure()
    if batch and batch[1] <= store.batch_done(batch[0]):
        return IngestionReport(elapsed_s=time.monotonic() - begun)
    embed = embed or HashedEmbedder(store.dimension)
    keys, rows = latest_changes(with_content_hash(docs), store.content_hashes)
    seen = keys.count()
    changed = stage(rows)
    new = changed.count()
    report = IngestionReport(seen, seen - new)
    centroids = store.load_centroids()
    groups = max(1, -(-new // flush_documents))
    fresh = changed if groups == 1 else stage(changed.withColumn("flush", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")), by="flush")
    for group in range(groups if new else 0):
        own = fresh if groups == 1 else fresh.where(F.col("flush") == group).drop("flush")
        try:
            report.add(*_flush(store, own, options, count, embed, centroids))
        except AnalysisException:
            raise  # no data makes a query that can't be planned
        except (HarrowError, PySparkException, Py4JError) as lost:
            log.warning("a group of documents could not be indexed: %s", lost)
            report.add(0, own.select("doc_id", F.lit(f"its group failed: {type(lost).__name__}").alias("reason")), broken=True)
    report.indexed = new - report.failed
    if batch and not report.broken:
        store.mark_batch(*batch)
    try:
        store.compact()
    except (HarrowError, PySparkException, Py4JError) as lost:  # what was written stands; the next run tries again
        log.warning("segments could not be merged: %s", lost)
    report.elapsed_s = time.monotonic() - begun
    return report


def _flush(store: IndexStore, docs: DataFrame, options: ChunkingOptions | None, count: TokenCounter, embed: Embedder, centroids: DataFrame | None) -> tuple[int, DataFrame]:
    """Chunk, embed and write one group: (chunks, documents that gave none with the reason)."""
    chunks = stage(chunk_documents(docs.drop("content_hash"), options, count))
    failed = stage(empty_documents(docs, chunks).select("doc_id", "reason"))
    dense = embed.documents(chunks.select("chunk_id", embedding_text("title", "section", "text").alias("text")), "chunk_id")
    rows = chunks.join(dense, "chunk_id", "left")
    if centroids is not None:
        rows = stage(rows)
        rows = rows.join(assign(rows.select("chunk_id", "dense"), centroids).select("chunk_id", "cluster_id"), "chunk_id", "left")
    else:
        rows = rows.withColumn("cluster_id", F.lit(None).cast("int"))
    store.replace(stage(rows.select(*CHUNK_SCHEMA.fieldNames())))
    return chunks.count(), failed


def ingest_stream(spark: SparkSession, store: IndexStore, folder: str, checkpoint: str, on_report: Callable[[IngestionReport], None] = lambda r: None, **options) -> StreamingQuery:
    """Ingest every JSONL file that arrives in ``folder``; available files are taken, then the stream stops.

    Progress lives in ``checkpoint``, and the last batch done in the index: one that is run
    again finds itself done, or, had it broken off, its first documents unchanged. A batch
    of which a group could not be written ends the stream, to be taken up at the next start.
    """
    source = spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", 64).json(folder)

    def batch(df: DataFrame, number: int) -> None:
        report = ingest(store, df, batch=(checkpoint, number), **options)
        on_report(report)
        report.check()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
