"""A stream of document changes that arrive late, twice or in any order, into the index.

Every change carries a sequence number of its document. A stateful operator keyed by
document remembers the number and hash last let through, so what arrives late or again
goes no further; what does goes on to the index in numbered batches, and the index knows
the last one it has in full. Whatever the order, the split into batches and the restarts,
the index ends up with the last change of each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.index import with_content_hash
from ..operators.store import IndexStore
from ..sources.corpus import DOCUMENT_SCHEMA
from .ingest import IngestionReport, ingest

CHANGE_SCHEMA = T.StructType([*DOCUMENT_SCHEMA, T.StructField("sequence", T.LongType()), T.StructField("deleted", T.BooleanType())])
LET_THROUGH = T.StructType([*CHANGE_SCHEMA, T.StructField("content_hash", T.StringType())])
_STORES = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rank(change) -> tuple:
    """A document's changes in order; of one number a deletion comes last, then the largest hash: never the order of arrival."""
    return change.sequence, bool(change.deleted), change.content_hash or ""


class LatestChange(StatefulProcessor):
    """Lets a document's last change through if it comes after all before and changes anything."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence bigint, deleted boolean, content_hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest = max(rows, key=_rank)
        own = (newest.sequence, bool(newest.deleted), newest.content_hash or "")
        if self.last.exists():
            known = tuple(self.last.get())
            if own <= known:
                return
            self.last.update(own)
            if own[1:] == known[1:]:
                return
        else:
            self.last.update(own)
        yield Row(**{f.name: getattr(newest, f.name) for f in LET_THROUGH})

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that keyed state needs, for a query that is started here."""
    before = spark.conf.get(_STORES[0], None)
    spark.conf.set(*_STORES)
    try:
        yield
    finally:
        spark.conf.unset(_STORES[0]) if before is None else spark.conf.set(_STORES[0], before)


def latest_changes_stream(changes: DataFrame) -> DataFrame:
    """Of a stream of changes (``CHANGE_SCHEMA``) those that are news; changes without id or number are left out."""
    rows = changes.where(F.col("doc_id").isNotNull() & F.col("sequence").isNotNull())
    hashed = with_content_hash(rows).withColumn("content_hash", F.when(~F.coalesce("deleted", F.lit(False)), F.col("content_hash"))).select(*LET_THROUGH.fieldNames())
    return hashed.groupBy("doc_id").transformWithState(LatestChange(), LET_THROUGH, "Append", "None")


def apply_changes(store: IndexStore, changes: DataFrame, batch: tuple[str, int], **options) -> IngestionReport:
    """One batch of changes (one a document): deleted documents go, the others are ingested; a batch that is done stays done."""
    store.ensure()
    if batch[1] <= store.batch_done(batch[0]):
        return IngestionReport()
    deleted = F.coalesce("deleted", F.lit(False))
    store.remove(changes.where(deleted).select("doc_id"))
    return ingest(store, changes.where(~deleted).select(*DOCUMENT_SCHEMA.fieldNames()), batch=batch, **options)


def ingest_changes(spark: SparkSession, store: IndexStore, folder: str, checkpoint: str, on_report: Callable[[IngestionReport], None] = lambda r: None, files_per_batch: int = 64, **options) -> StreamingQuery:
    """Apply every JSONL file of changes that arrives in ``folder``; available files are taken, then the stream stops.

    A batch of which a group could not be written ends the stream; started again, it
    takes the same batch up. ``checkpoint`` names the stream to the index.
    """
    changes = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        try:
            report = apply_changes(store, held, (checkpoint, number), **options)
        finally:
            held.unpersist()
        on_report(report)
        report.check()

    with _state_store(spark):
        return latest_changes_stream(changes).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
