"""Shared plumbing of the operators: staged tables, schemas, column names."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
_STAGED: list[tuple[object, object]] = []
#: Seconds between two times that the driver gives memory back while tables are staged, and when it last did.
RELEASE_SECONDS = 5.0
_released = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may leave it
    unset (tests, a laptop): then a temporary folder of our own is used, and set as
    the checkpoint folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="harrow-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/harrow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    _STAGED.append((hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop))
    return path


def release(spark: SparkSession) -> None:
    """Give the driver's unused memory back.

    The JVM keeps plans as long as Python names them, also in cycles, and Spark removes the
    broadcast tables and shuffle files of plans once the JVM has collected these. A driver of
    many short jobs would otherwise only grow.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and outlives lost executors; removed when the application ends.
    """
    global _released
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - _released >= RELEASE_SECONDS:
        release(spark)
        _released = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for fs, path in _STAGED:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_sweep)


def first_by_hash(rows: DataFrame, by: str, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows for each value of ``by`` (a few values), the first in the order of a hash of ``key``.

    A bar on the hash, set from the counts, first leaves out all rows that surely come
    later, so little is put in order however many rows there are.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)
    bar = F.lit(False)
    for value, count in counts.items():
        share = min(1.0, (1.2 * n + 100) / max(1, count))
        bar = bar | (F.col(by).eqNullSafe(F.lit(value)) & (place <= F.lit(min((1 << 63) - 1, int(share * (1 << 63))))))
    order = Window.partitionBy(by).orderBy(place, key)
    return rows.where(bar).withColumn("harrow_place", F.row_number().over(order)).where(F.col("harrow_place") <= n).drop("harrow_place")


BROADCAST_BYTES = 32 << 20


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` to be broadcast, if its rows of at most so many bytes (with a hash table's share) stay below ``BROADCAST_BYTES``."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def lean(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A Python task that hands freed memory back when it ends; Spark keeps its worker for later tasks."""

    @functools.wraps(task)
    def run(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
