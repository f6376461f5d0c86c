"""Spherical k-means: fitting, choice of k, assignment, quality.

The fit goes through the vectors in batches. All restarts of all numbers of clusters are
brought forward by one pass over a batch: a task multiplies its rows with the centres of
all models at once and hands on a count, a sum and a cost for each centre. A centre moves by
the batch's mean, weighed by how many vectors it has met so far.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ClusteringError
from ..functions.vectors import dot, unit
from ..options import ClusteringOptions
from ..staging import stage

#: A pass over all vectors has at most so many batches: on large tables these have more than ``batch_rows`` rows.
MOST_BATCHES = 64
#: Batches' worth of vectors that the starting centres are picked from.
START_BATCHES = 3
#: Rows that a task holds against all centres at once.
ROWS_AT_ONCE = 1024
DECIMALS = 12


@dataclass
class ClusterModel:
    centroids: list[list[float]]
    k: int
    silhouette: float
    version: str
    silhouette_by_k: dict[int, float] = field(default_factory=dict)


def version_of(centroids: list[list[float]]) -> str:
    """``k<K>-`` and 12 hex digits of a hash over the centroids as float32."""
    data = b"".join(struct.pack(f"<{len(c)}f", *c) for c in centroids)
    return f"k{len(centroids)}-{hashlib.sha256(data).hexdigest()[:12]}"


def centroid_table(model: ClusterModel, spark) -> DataFrame:
    return spark.createDataFrame([(i, c, model.version) for i, c in enumerate(model.centroids)], "cluster_id int, centroid array<double>, version string")


def with_nearest(vectors: DataFrame, centroids: DataFrame, vector: str = "dense") -> DataFrame:
    """``vectors`` (those that aren't null) with cluster_id and similarity: the nearest centroid by cosine, ties to the smaller cluster."""
    table = F.broadcast(centroids.select("cluster_id", unit("centroid").alias("c")).agg(F.sort_array(F.collect_list(F.struct("cluster_id", "c"))).alias("all")))
    near = F.transform("all", lambda x: F.struct(F.round(dot("u", x["c"]), 12).alias("s"), (-x["cluster_id"]).alias("minus")))
    rows = vectors.drop("cluster_id", "similarity").where(F.col(vector).isNotNull())
    best = rows.withColumn("u", unit(vector)).join(table).withColumn("best", F.array_max(near))
    return best.select(*rows.columns, (-F.col("best.minus")).cast("int").alias("cluster_id"), F.col("best.s").alias("similarity"))


def assign(vectors: DataFrame, centroids: DataFrame, id_col: str = "chunk_id", vector: str = "dense") -> DataFrame:
    """(id, cluster_id, similarity): the nearest centroid by cosine, ties to the smaller cluster."""
    return with_nearest(vectors.select(id_col, vector), centroids, vector).select(id_col, "cluster_id", "similarity")


def cluster_sizes(centroids: DataFrame, assignments: DataFrame) -> DataFrame:
    counts = assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return centroids.select("cluster_id").join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def cluster_sums(vectors: DataFrame, vector: str = "dense") -> DataFrame:
    """(cluster_id, n, total): sums of unit vectors, by coordinate; partial sums are made before the shuffle."""
    parts = vectors.select("cluster_id", F.posexplode(unit(vector)).alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("total"))


def lloyd_step(vectors: DataFrame, vector: str = "dense") -> DataFrame:
    """(cluster_id, centroid): unit means of the clusters as labelled."""
    return cluster_sums(vectors, vector).select("cluster_id", unit("total").alias("centroid"))


def silhouettes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "dense") -> DataFrame:
    """(id, cluster_id, silhouette) under cosine distance, in time linear in the rows.

    The mean cosine distance to a cluster is one less the product with its mean unit
    vector, so cluster sums stand in for all pairs. A cluster of one has silhouette 0.
    """
    sums = F.broadcast(cluster_sums(vectors, vector).agg(F.collect_list(F.struct("cluster_id", "n", "total")).alias("all")))
    rows = vectors.select(id_col, "cluster_id", unit(vector).alias("u")).join(sums)
    far = F.transform("all", lambda c: F.struct(c["cluster_id"].alias("c"), c["n"].alias("n"), (c["n"] - dot("u", c["total"])).alias("d")))
    own = F.filter("far", lambda c: c["c"] == F.col("cluster_id"))[0]
    others = F.transform(F.filter("far", lambda c: c["c"] != F.col("cluster_id")), lambda c: c["d"] / c["n"])
    rows = rows.withColumn("far", far).withColumn("own", own).withColumn("b", F.array_min(others))
    # The distance to itself is one less its squared norm, which is 0 for unit vectors.
    a = (F.col("own.d") - (1 - dot("u", "u"))) / (F.col("own.n") - 1)
    s = F.when((F.col("own.n") <= 1) | F.col("b").isNull() | (F.greatest(a, "b") == 0), F.lit(0.0)).otherwise((F.col("b") - a) / F.greatest(a, "b"))
    return rows.select(id_col, "cluster_id", s.alias("silhouette"))


def mean_silhouette(vectors: DataFrame, id_col: str, vector: str = "dense") -> float:
    """Mean silhouette; -1 with fewer than two clusters in use."""
    if vectors.select("cluster_id").distinct().limit(2).count() < 2:
        return -1.0
    return float(silhouettes(vectors, id_col, vector).agg(F.avg("silhouette")).first()[0])


def _unit_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            own = batch.slice(first, ROWS_AT_ONCE)
            yield _unit_rows(own.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(own.num_rows, -1))


def _labels(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """As ``with_nearest`` labels them."""
    return np.round(rows @ centres.T, DECIMALS).argmax(axis=1)


def nearest_silhouettes(vectors: DataFrame, models: list[np.ndarray], vector: str = "dense") -> list[float]:
    """For each model (unit centres) the ``mean_silhouette`` of all rows, each in the cluster of its nearest centre.

    All models share two passes: one sums the clusters, one the silhouettes. A task hands on a row for each centre, then for each model.
    """
    ends = np.cumsum([len(m) for m in models])
    spans = [(e - len(m), e) for m, e in zip(models, ends.tolist(), strict=True)]
    width = models[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, totals = np.zeros(ends[-1], np.int64), np.zeros((ends[-1], width))
        for rows in _unit_slices(batches):
            for m, (a, b) in zip(models, spans, strict=True):
                code = _labels(rows, m)
                met[a:b] += np.bincount(code, minlength=b - a)
                np.add.at(totals, a + code, rows)
        used = np.flatnonzero(met)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(totals[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(met[used]), flat], names=["centre", "met", "total"])

    parts = vectors.select(vector).mapInArrow(sums, "centre int, met bigint, total array<double>")
    met, totals = np.zeros(ends[-1]), np.zeros((ends[-1], width))
    for r in parts.groupBy("centre").agg(F.sum("met").alias("met"), Summarizer.sum(array_to_vector("total")).alias("total")).collect():
        met[r.centre], totals[r.centre] = r.met, r.total.toArray()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(models))
        for rows in _unit_slices(batches):
            at = np.arange(len(rows))
            for i, (m, (a, b)) in enumerate(zip(models, spans, strict=True)):
                code, n = _labels(rows, m), met[a:b]
                far = n - rows @ totals[a:b].T
                # The distance to itself is one less its squared norm, which is 0 for unit vectors.
                inner = (far[at, code] - (1 - (rows * rows).sum(axis=1))) / np.maximum(n[code] - 1, 1)
                others = np.where(n > 0, far / np.maximum(n, 1), np.inf)
                others[at, code] = np.inf
                outer = others.min(axis=1)
                most = np.maximum(inner, outer)
                counts = (n[code] > 1) & (outer < np.inf) & (most != 0)
                found[i] += ((outer - inner)[counts] / most[counts]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(found)], names=["model", "s"])

    total = {r.model: r.s for r in vectors.select(vector).mapInArrow(scores, "model int, s double").groupBy("model").agg(F.sum("s").alias("s")).collect()}
    return [float(total[i] / met[a:b].sum()) if np.count_nonzero(met[a:b]) > 1 else -1.0 for i, (a, b) in enumerate(spans)]


@dataclass
class Centres:
    """Centres in the making, and how many vectors each has met."""

    centres: np.ndarray
    met: np.ndarray
    cost: float = float("inf")

    @classmethod
    def of(cls, centres: np.ndarray) -> Centres:
        return cls(centres, np.zeros(len(centres)))


def starting_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of the sample by k-means++: each is drawn by its squared distance to those before, the best of a few draws."""
    tries = 2 + int(np.log(k))
    picked = [int(rng.integers(len(sample)))]
    near = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = near.sum()
        drawn = rng.choice(len(sample), tries, p=near / total) if total > 0 else rng.integers(len(sample), size=tries)
        after = [np.minimum(near, ((sample - sample[i]) ** 2).sum(axis=1)) for i in drawn]
        best = int(np.argmin([a.sum() for a in after]))
        picked.append(int(drawn[best]))
        near = after[best]
    return sample[picked].astype(float)


def _batch_sums(batch: DataFrame, models: list[Centres], vector: str) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each model the count and the sum of each centre's nearest rows, and the sum of squared distances to them.

    ``batch`` has unit vectors. What comes back is a row for each centre.
    """
    centres = np.concatenate([m.centres for m in models])
    ends = np.cumsum([len(m.centres) for m in models])
    spans = list(zip((ends - [len(m.centres) for m in models]).tolist(), ends.tolist(), strict=True))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, sums, cost = np.zeros(len(centres), np.int64), np.zeros(centres.shape), np.zeros(len(centres))
        squared = (centres * centres).sum(axis=1)
        for own in batches:
            if not own.num_rows:
                continue
            rows = own.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(own.num_rows, -1)
            far = np.round((rows * rows).sum(axis=1)[:, None] + squared - 2 * rows @ centres.T, DECIMALS)
            for a, b in spans:
                code = far[:, a:b].argmin(axis=1)
                met[a:b] += np.bincount(code, minlength=b - a)
                np.add.at(sums, a + code, rows)
                cost[a:b] += np.bincount(code, weights=far[np.arange(len(rows)), a + code], minlength=b - a)
        used = np.flatnonzero(met)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * centres.shape[1], pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(met[used]), pa.array(cost[used]), flat], names=["centre", "met", "cost", "total"])

    parts = batch.select(vector).mapInArrow(task, "centre int, met bigint, cost double, total array<double>")
    rows = parts.groupBy("centre").agg(F.sum("met").alias("met"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("total")).alias("total")).collect()
    met, sums, cost = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
    for r in rows:
        met[r.centre], cost[r.centre], sums[r.centre] = r.met, r.cost, r.total.toArray()
    return [(met[a:b], sums[a:b], float(cost[a:b].sum())) for a, b in spans]


def minibatch_step(batch: DataFrame, models: list[Centres], vector: str = "dense") -> list[float]:
    """Move all models' centres by one batch of unit vectors, in place; the cost of the batch before the move, by model.

    A centre that meets ``n`` vectors after ``met`` goes ``n / (met + n)`` of the way to their mean.
    """
    costs = []
    for m, (n, total, cost) in zip(models, _batch_sums(batch, models, vector), strict=True):
        m.met = m.met + n
        m.centres = np.round(m.centres + np.where(n[:, None] > 0, (total - n[:, None] * m.centres) / np.maximum(m.met, 1)[:, None], 0.0), DECIMALS)
        costs.append(cost)
    return costs


def _unit_rows(centres: np.ndarray) -> np.ndarray:
    length = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    return centres / np.where(length == 0, 1, length)


def minibatch_models(rows: DataFrame, grid: list[int], n: int, options: ClusteringOptions, id_col: str, vector: str) -> dict[int, np.ndarray]:
    """Unit centres for each number of clusters: the best of ``n_init`` restarts, all of which share every pass.

    Batches are dealt by a hash of the id, so they are the same on every run. Every pass
    takes in all rows; a model rests once a pass lowers its cost by less than
    ``tolerance`` of it, at the latest after ``max_passes``. Starting centres come from
    the first ``START_BATCHES * batch_rows`` vectors in the order of another hash.
    """
    batches = min(MOST_BATCHES, -(-n // options.batch_rows))
    place = F.pmod(F.xxhash64(F.lit(options.random_state), id_col), F.lit(batches)).cast("int")
    dealt = stage(rows.select(vector, place.alias("batch")), by="batch")
    order = F.xxhash64(F.lit(options.random_state + 1), id_col)
    sample = np.array([r[0] for r in rows.select(vector, order.alias("o"), id_col).orderBy("o", id_col).limit(max(START_BATCHES * options.batch_rows, 3 * max(grid))).select(vector).collect()], float)
    models = {(k, s): Centres.of(starting_centres(sample, k, np.random.default_rng([options.random_state, k, s]))) for k in grid for s in range(options.n_init)}
    active = dict(models)
    for _ in range(options.max_passes):
        cost = dict.fromkeys(active, 0.0)
        for b in range(batches):
            for key, c in zip(active, minibatch_step(dealt.where(F.col("batch") == b), list(active.values()), vector), strict=True):
                cost[key] += c
        rested = [key for key, m in active.items() if m.cost - cost[key] <= options.tolerance * cost[key]]
        for key, m in active.items():
            m.cost = cost[key]
        for key in rested:
            del active[key]
        if not active:
            break
    final = [Centres.of(_unit_rows(m.centres)) for m in models.values()]
    costs = {key: cost for key, (_, _, cost) in zip(models, _batch_sums(dealt, final, vector), strict=True)}
    best = {k: min(range(options.n_init), key=lambda s: (round(costs[k, s], 9), s)) for k in grid}  # noqa: B023
    return {k: final[list(models).index((k, best[k]))].centres for k in grid}


def lloyd_models(rows: DataFrame, grid: list[int], options: ClusteringOptions, vector: str) -> dict[int, np.ndarray]:
    """Unit centres for each number of clusters by whole passes of Spark's own k-means, the best of ``n_init`` seeds."""
    made = {}
    data = rows.withColumn("features", array_to_vector(vector)).persist()
    try:
        for k in grid:
            models = [KMeans(k=k, seed=options.random_state + s, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster_id").fit(data) for s in range(options.n_init)]
            made[k] = _unit_rows(np.array(min(models, key=lambda m: m.summary.trainingCost).clusterCenters()))
    finally:
        data.unpersist()
    return made


def fit(vectors: DataFrame, options: ClusteringOptions | None = None, id_col: str = "chunk_id", vector: str = "dense") -> ClusterModel:
    """Cosine k-means by mini-batches (or whole passes), best of five restarts; k fixed or by the largest mean silhouette, ties to the smaller.

    Labels are those of the unit centroids. The silhouette is exact and linear, so no
    sample is drawn for it.
    """
    options = options or ClusteringOptions()
    rows = stage(vectors.where(F.col(vector).isNotNull()).select(id_col, unit(vector).alias(vector)))
    n = rows.count()
    grid = [options.n_clusters] if options.n_clusters else sorted({k for k in options.k_grid if 2 <= k < n})
    if not grid or grid[0] >= n:
        raise ClusteringError(f"{n} vectors can't be put into clusters of {options.n_clusters or options.k_grid}")
    made = minibatch_models(rows, grid, n, options, id_col, vector) if options.method == "minibatch" else lloyd_models(rows, grid, options, vector)
    models = {k: ClusterModel(c.tolist(), k, 0.0, version_of(c.tolist())) for k, c in made.items()}
    scores = dict(zip(made, nearest_silhouettes(rows, list(made.values()), vector), strict=True))
    best = max(scores, key=lambda k: (scores[k], -k))
    return ClusterModel(models[best].centroids, best, scores[best], models[best].version, scores)


def recluster(store, options: ClusteringOptions | None = None) -> ClusterModel:
    """Fit on all stored vectors; write centroids and every chunk's cluster."""
    vectors = store.dense_vectors()
    if vectors.where(F.col("dense").isNotNull()).isEmpty():
        raise ClusteringError("the index holds no vectors")
    model = fit(vectors, options)
    table = centroid_table(model, store.spark)
    store.write_cluster_model(table, assign(vectors, table).select("chunk_id", "cluster_id"))
    return model


def purity(labelled: DataFrame, cluster: str = "cluster_id", topic: str = "topic") -> DataFrame:
    """One row, purity: the share of rows in their cluster's commonest topic; null without rows."""
    counts = labelled.where(F.col(cluster).isNotNull() & F.col(topic).isNotNull()).groupBy(cluster, topic).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(cluster).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return most.agg(F.round(F.sum("most") / F.sum("all"), 4).alias("purity"))


def commonest(labelled: DataFrame, cluster: str = "cluster_id", topic: str = "topic") -> DataFrame:
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), topic)
    counts = labelled.groupBy(cluster, topic).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
