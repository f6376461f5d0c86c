"""Ranking metrics, their summaries, and bootstrap intervals, as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage

RESAMPLES = 2000
#: Places of a draw that make one row, and values that a task holds at once (32 MB).
BLOCK_PLACES = 1 << 16
MATRIX_VALUES = 1 << 22
LOSS = 1e-9


def score_rankings(results: DataFrame, relevant: DataFrame, k: int, keys: tuple[str, ...] = ("config", "query_id")) -> DataFrame:
    """One row for each of ``keys`` with results: first_relevant_rank, recall_at_5, recall_at_k, ndcg_at_k, mrr_at_k, distinct_docs.

    ``results``: keys, rank (from 1), doc_id (canonical). ``relevant``: query_id, doc_id.
    Ranks are of chunks; only a document's first chunk gains. Recall and nDCG of a query
    without relevant documents are null and 0.
    """
    top = results.where(F.col("rank") <= k)
    first = Window.partitionBy(*keys, "doc_id").orderBy("rank")
    truth = relevant.select("query_id", "doc_id").distinct()
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = top.withColumn("again", F.row_number().over(first)).join(truth.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").join(sizes, "query_id", "left")
    gain = F.when((F.col("again") == 1) & F.col("hit").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("gain", gain)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.max("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    dcg = F.sum(F.col("gain") / F.log2(F.col("rank") + 1))
    firsts = F.min(F.when(F.col("gain") == 1, F.col("rank")))
    out = rows.groupBy(*keys).agg(
        firsts.cast("bigint").alias("first_relevant_rank"),
        (F.sum(F.when(F.col("rank") <= 5, F.col("gain"))) / F.max("n_relevant")).alias("recall_at_5"),
        (F.sum("gain") / F.max("n_relevant")).alias("recall_at_k"),
        F.when(F.max("n_relevant").isNull(), F.lit(0.0)).otherwise(dcg / ideal).alias("ndcg_at_k"),
        F.coalesce(1 / firsts, F.lit(0.0)).alias("mrr_at_k"),
        F.count_distinct("doc_id").alias("distinct_docs"),
    )
    return out


def intra_list_similarity(results: DataFrame, vectors: DataFrame, k: int, keys: tuple[str, ...] = ("config", "query_id"), id_col: str = "doc_id", vector: str = "dense") -> DataFrame:
    """Keys and ils: mean product of the unit vectors of each two of the top ``k``; 0 below two.

    All pairs come from the sum of the vectors: twice their products' sum is its
    square less the vectors' own squares.
    """
    top = results.where(F.col("rank") <= k).join(vectors.select(id_col, vector), id_col)
    parts = top.select(*keys, "rank", F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    total = F.sum(F.col("s") * F.col("s")) - F.sum("q")
    return parts.groupBy(*keys).agg(F.when(n < 2, F.lit(0.0)).otherwise(total / (n * (n - 1))).alias("ils"))


def summarize(scores: DataFrame, by: tuple[str, ...] = ("config",), metrics: tuple[str, ...] = ("ndcg_at_k", "recall_at_5", "recall_at_k", "mrr_at_k", "distinct_docs")) -> DataFrame:
    """Means of the metrics, and the number of queries."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(m).alias(m) for m in metrics])


def median_latency(timings: DataFrame, by: tuple[str, ...] = ("config",), value: str = "latency_ms") -> DataFrame:
    return timings.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("p50_ms"))


def paired_delta(scores: DataFrame, baseline: str, metric: str = "ndcg_at_k") -> DataFrame:
    """config, query_id, delta: each query's metric less the baseline's."""
    base = scores.where(F.col("config") == baseline).select("query_id", F.col(metric).alias("base"))
    return scores.join(base, "query_id").select("config", "query_id", (F.col(metric) - F.col("base")).alias("delta"))


def resamples(spark: SparkSession, n: int, count: int = RESAMPLES, block: int = BLOCK_PLACES) -> DataFrame:
    """(draw, places): ``n`` positions below ``n`` with replacement for each of ``count`` draws, ``block`` of them a row.

    They come from a hash of draw and place, so they are always the same.
    """
    blocks = -(-n // block)
    rows = spark.range(0, count * blocks, 1, min(count * blocks, spark.sparkContext.defaultParallelism)).select(F.floor(F.col("id") / blocks).cast("bigint").alias("draw"), (F.col("id") % blocks * block).alias("first"))
    places = F.sequence("first", F.least(F.col("first") + block, F.lit(n)) - 1)
    drawn = F.transform(places, lambda p: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), p.cast("string"))), 1, 8), 16, 10).cast("bigint") % n)
    return rows.select("draw", drawn.alias("places"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """The distinct values of ``order`` with ``i``, their place from 0 in ascending order; no task holds more than its range."""
    ranged = rows.select(order).distinct().repartitionByRange(order).sortWithinPartitions(order)
    own = stage(ranged.select(order, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")))
    before, starts = 0, []
    for r in own.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return own.join(F.broadcast(table), "part").select(order, (F.col("start") + F.col("at")).alias("i"))


def bootstrap_ci(values: DataFrame, value: str, by: str = "config", order: str = "query_id", count: int = RESAMPLES) -> DataFrame:
    """by, mean, lo, hi: percentile interval (2.5, 97.5, linear) of the mean over ``count`` resamples.

    Queries are numbered in order of ``order`` and all groups use the same draws, so
    intervals of differences are paired. Groups are expected to hold the same queries.
    A task counts how often a draw takes each query and multiplies these counts with the
    values of all groups, which it holds as one matrix of at most ``MATRIX_VALUES``
    values; more queries than that are taken a slice of the matrix at a time.
    """
    spark = values.sparkSession
    values = stage(values.select(by, order, value).where(F.col(value).isNotNull()))
    groups = [r[0] for r in values.select(by).distinct().orderBy(by).collect()]
    if not groups:
        return spark.createDataFrame([], f"{by} string, mean double, lo double, hi double")
    places = stage(numbered(values, order))
    n = places.count()
    rows = values.join(places, order).select(by, "i", F.col(value).cast("double").alias("v"))
    width = max(1, MATRIX_VALUES // len(groups))
    if n > width:
        rows = stage(rows.withColumn("slice", F.floor(F.col("i") / width).cast("int")), by="slice")
    draws, sums = resamples(spark, n, count), None
    for first in range(0, n, width):
        some = rows.where(F.col("slice") == first // width) if n > width else rows
        matrix = np.full((min(width, n - first), len(groups)), np.nan)
        column = {g: c for c, g in enumerate(groups)}
        for r in some.toLocalIterator():
            matrix[r.i - first, column[r[by]]] = r.v
        part = _drawn_sums(draws, spark.sparkContext.broadcast((np.nan_to_num(matrix), ~np.isnan(matrix))), first)
        sums = part if sums is None else sums.unionAll(part)
    if n > min(width, BLOCK_PLACES):
        sums = sums.groupBy("draw", "g").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    ends = sums.where("n > 0").groupBy("g").agg(F.percentile(F.col("s") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    named = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], f"g int, own {dict(values.dtypes)[by]}")
    means = values.groupBy(by).agg(F.avg(value).alias("mean")).join(F.broadcast(named), F.col(by).eqNullSafe(F.col("own"))).drop("own")
    return means.join(F.broadcast(ends), "g").select(by, "mean", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def _drawn_sums(draws: DataFrame, sent, first: int) -> DataFrame:
    """(draw, g, s, n): the sum and number of a group's values among a row's places, of the values from place ``first`` on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, there = sent.value
        for batch in batches:
            draw, lists = batch.column("draw").to_numpy(), batch.column("places")
            sums, found = np.zeros((len(draw), matrix.shape[1])), np.zeros((len(draw), matrix.shape[1]), np.int64)
            for k in range(len(draw)):
                at = lists[k].values.to_numpy() - first
                counts = np.bincount(at[(at >= 0) & (at < len(matrix))], minlength=len(matrix))
                sums[k], found[k] = counts @ matrix, counts @ there
            g = np.tile(np.arange(matrix.shape[1], dtype=np.int32), len(draw))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(draw, matrix.shape[1])), pa.array(g), pa.array(sums.ravel()), pa.array(found.ravel())], names=["draw", "g", "s", "n"])

    return draws.mapInArrow(task, "draw bigint, g int, s double, n bigint")


def outside(relevant_clusters: Column, routed: Column, m: int) -> Column:
    """Whether some relevant chunk lies in none of the first ``m`` routed clusters."""
    return F.size(F.array_except(relevant_clusters, F.slice(routed, 1, m))) > 0


def routing_loss(rows: DataFrame, m: int) -> DataFrame:
    """One row of counts from (query_id, hybrid, routed_score, relevant_clusters, routed): queries that lost nDCG
    under routing, relevant outside the routed clusters, both, and the loss rates outside and inside."""
    flagged = rows.select((F.col("routed_score") < F.col("hybrid") - LOSS).alias("lost"), outside(F.col("relevant_clusters"), F.col("routed"), m).alias("out"))
    rate = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b))
    lost, out = F.col("lost"), F.col("out")
    return flagged.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(lost).alias("lost"), F.count_if(out).alias("outside"), F.count_if(lost & out).alias("lost_outside"),
        rate(lost, out).alias("loss_rate_outside"), rate(lost, ~out).alias("loss_rate_inside"),
    )
