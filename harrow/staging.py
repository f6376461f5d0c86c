"""Tables that are written once and read several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationError

_STAGED: list[tuple[object, object]] = []


def stage_path(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; removed when the application ends.

    The session names the shared folder in ``spark.checkpoint.dir``. Only a session with
    executors in the driver's process may do without: it gets a temporary one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="harrow-stage-")
        sc.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/harrow-stage-{sc.applicationId}/{uuid.uuid4().hex[:12]}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    _STAGED.append((hadoop.getFileSystem(sc._jsc.hadoopConfiguration()), hadoop))
    return path


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, without lineage, safe from lost executors.

    With ``by`` (a column of few values) the rows lie in folders by it, so that a filter on it reads its own only.
    """
    path = stage_path(df.sparkSession)
    rows = df.write.option("compression", "zstd")
    (rows.partitionBy(by) if by else rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _sweep() -> None:
    for fs, path in _STAGED:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_sweep)
