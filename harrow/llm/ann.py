"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed in ``TABLES`` tables of ``K`` functions ``floor((a.x + b) / w)``
with Gaussian ``a``. A query visits, in each table, its own bucket and then those of
the perturbations of one step up or down, in order of estimated success (the squared
distances to the bucket walls that have to be crossed). Which sets of steps may come
first is worked out once from the expected distances (Lv et al. 2007); a query then
puts these in the order of its own.

Largest inner product is turned into least distance by one more coordinate:
``x / M`` gets ``sqrt(1 - |x|^2 / M^2)`` (M: the largest norm), queries get 0.

A table's buckets are dealt to shards of a bounded number of rows; a bucket beyond
that is split over shards of its own. A vector is sent once a table, a query once to
each shard that holds one of its buckets, with the list of these. A shard ranks the
rows of the listed buckets by exact inner products, and the tables' lists are merged.

``K`` starts from the number of vectors. The number of probes is fitted, in one task:
on a sample of at most ``FIT_ROWS`` index rows and ``FIT_QUERIES`` queries, the fewest
that find ``target`` of the sample's true neighbours (which are farther apart than
those of the whole table, so the whole does no worse). Where ``MOST_PROBES`` don't,
``K`` is lowered until they do. Every row is indexed. Queries whose buckets hold fewer
than ``k`` rows are compared with all rows, block by block.

Of equal vectors only the ``k + 1`` smallest ids can be in a result, as ties go to the
smaller id; the others are left out of the index, which loses nothing.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, staged
from .tokens import binary_column
from .words import mix

TABLES = 4
WIDTH = 1.5
SPREAD = 3.3
BUCKET_ROWS = 500
MOST_FUNCTIONS = 10
MOST_PROBES = 256
SHARD_ROWS = 1 << 15
LEAST_SHARDS = 8
ASK_AT_ONCE = 256
FIT_ROWS = 20_000
FIT_QUERIES = 200
TARGET = 0.97
SEED = 20
_ENTRY = "shard int, asks boolean, id bigint, cells binary, vector binary"


class Hashes:
    """The functions of all tables for vectors of ``dim`` coordinates (and the added one)."""

    def __init__(self, dim: int, functions: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, functions])
        self.functions = functions
        self.a = rng.standard_normal((dim + 1, TABLES * functions))
        self.b = rng.uniform(0, WIDTH, TABLES * functions)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Positions (rows, tables, functions) in units of the bucket width."""
        return ((x @ self.a + self.b) / WIDTH).reshape(len(x), TABLES, self.functions)


def augmented(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    if query:
        return np.hstack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))))
    x = x / largest
    return np.hstack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))))


def bucket_keys(table: int, buckets: np.ndarray, dim: int) -> np.ndarray:
    """64-bit keys of integer bucket coordinates (..., functions)."""
    key = mix(np.full(buckets.shape[:-1], 1000 * dim + 1 + table, np.uint64))
    for j in range(buckets.shape[-1]):
        key = mix(key ^ (buckets[..., j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


@functools.cache
def step_sets(functions: int, most: int) -> np.ndarray:
    """(sets, 2 * functions): which of the steps, nearest wall first, each set takes; least expected cost first.

    The sets come off a heap, each followed by its shifted and its expanded set. A set
    never holds both steps of a function, which are as far from one end of the order
    as from the other.
    """
    k = functions
    nearer = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) for j in range(k)]
    farther = [1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k + 1 - j) / (4 * (k + 1) * (k + 2)) for j in range(k, 2 * k)]
    cost = nearer + farther
    out, heap = [np.zeros(2 * k, np.int8)], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        if len({min(i, 2 * k - 1 - i) for i in chosen}) == len(chosen):
            own = np.zeros(2 * k, np.int8)
            own[list(chosen)] = 1
            out.append(own)
    return np.array(out)


def probe_moves(inside: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, functions): perturbations of the home bucket, least cost first; ``inside``: positions within it, 0..1."""
    rows, k = inside.shape
    sets = step_sets(k, 3 * probes)
    walls = np.hstack((inside, 1 - inside))
    order = np.argsort(walls, axis=1, kind="stable")
    cost = np.take_along_axis(walls, order, 1) ** 2 @ sets.T.astype(float)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    step = np.zeros((rows, 2 * k, k), np.int8)
    row, place = np.repeat(np.arange(rows), 2 * k), np.tile(np.arange(2 * k), rows)
    step[row, place, (order % k).ravel()] = np.where(order < k, -1, 1).ravel()
    moves = np.einsum("rpj,rjk->rpk", sets[best].astype(np.float32), step.astype(np.float32), optimize=True)
    return moves.astype(np.int64)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in the batch."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[begin[rows][:, None] + np.arange(dim)]


def _images(x: np.ndarray) -> pa.Array:
    return binary_column(x.ravel(), np.full(len(x), x.shape[1]))


class Shards:
    """Where buckets lie: ``per_table`` shards a table, then those of each hot bucket (key, first shard, shards)."""

    def __init__(self, per_table: int, hot: list[tuple[int, int]]):
        self.per_table = per_table
        hot = sorted(hot)
        self.keys = np.array([key for key, _ in hot], np.int64)
        self.parts = np.array([parts for _, parts in hot], np.int64)
        self.first = TABLES * per_table + np.cumsum(self.parts) - self.parts
        self.count = TABLES * per_table + int(self.parts.sum())

    def _hot(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def of_rows(self, table: int, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        hot, at = self._hot(keys)
        out = table * self.per_table + (mix(keys.view(np.uint64)) % np.uint64(self.per_table)).astype(np.int64)
        if hot.any():
            out[hot] = self.first[at[hot]] + (mix(ids[hot].view(np.uint64)) % self.parts[at[hot]].astype(np.uint64)).astype(np.int64)
        return out

    def of_probes(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, shard): every shard that holds a part of the probed bucket."""
        hot, at = self._hot(keys)
        count = np.where(hot, self.parts[at] if len(self.keys) else 1, 1)
        who = np.repeat(np.arange(len(keys)), count)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        plain = table * self.per_table + (mix(keys.view(np.uint64)) % np.uint64(self.per_table)).astype(np.int64)
        return who, np.where(hot[who], (self.first[at] if len(self.keys) else plain)[who] + nth, plain[who])


@lean
def _cells(batches: Iterator[pa.RecordBatch], functions: int, largest: float) -> Iterator[pa.RecordBatch]:
    """(cell, n): rows of this batch in each bucket of each table."""
    made: dict[int, Hashes] = {}
    for batch in batches:
        for _, x in _vectors(batch.column("vector")):
            dim = x.shape[1]
            at = np.floor(made.setdefault(dim, Hashes(dim, functions)).place(augmented(x.astype(float), largest, False))).astype(np.int64)
            for t in range(TABLES):
                keys, count = np.unique(bucket_keys(t, at[:, t], dim), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], names=["cell", "n"])


@lean
def _entries(batches: Iterator[pa.RecordBatch], functions: int, largest: float, probes: int, shards: Shards, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """An index row once a table; a query once for each shard with buckets that it probes."""
    made: dict[int, Hashes] = {}
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            batch = whole.slice(i, 1000)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, x in _vectors(batch.column("vector")):
                dim, own = x.shape[1], ids[rows]
                at = made.setdefault(dim, Hashes(dim, functions)).place(augmented(x.astype(float), largest, probes > 0))
                home = np.floor(at).astype(np.int64)
                for t in range(TABLES):
                    if probes:
                        moves = probe_moves(at[:, t] - home[:, t], probes)
                        keys = bucket_keys(t, home[:, t][:, None] + moves, dim)
                        probe, shard = shards.of_probes(t, keys.ravel())
                        who = probe // keys.shape[1]
                        order = np.lexsort((probe, shard, who))
                        who, shard, cells = who[order], shard[order], keys.ravel()[probe[order]]
                        head = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (shard[1:] != shard[:-1]))))
                        count = np.diff(np.concatenate((head, [len(who)])))
                        who, shard = who[head], shard[head]
                    else:
                        who, cells = np.arange(len(x)), bucket_keys(t, home[:, t], dim)
                        shard, count = shards.of_rows(t, cells, own), np.ones(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.full(len(who), probes > 0)), pa.array(own[who]), binary_column(cells, count), _images(x[who])], schema=schema)


@lean
def _dealt(batches: Iterator[pa.RecordBatch], parts: int, asks: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows by a hash of their id, queries to every part, with the length of the vector as the one bucket."""
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for rows, x in _vectors(batch.column("vector")):
            own = ids[rows]
            places = range(parts) if asks else [(mix(own.view(np.uint64)) % np.uint64(parts)).astype(np.int32)]
            for place in places:
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(place), n) if asks else place), pa.array(np.full(n, asks)), pa.array(own), binary_column(np.full(n, x.shape[1], np.int64), np.ones(n, np.int64)), _images(x)], schema=schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id; an id counts once, with its best score."""
    order = np.lexsort((ids, -scores))
    if len(order) > k and len(np.unique(ids)) == len(ids):
        return order[:k]
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


class _Shard:
    """The index rows of one shard and one length of vector, ordered by bucket."""

    def __init__(self, cells: list[np.ndarray], ids: list[np.ndarray], vectors: list[np.ndarray]):
        own = np.concatenate(cells)
        order = np.argsort(own, kind="stable")
        self.cells, self.ids = own[order], np.concatenate(ids)[order]
        self.matrix = np.concatenate(vectors)[order].astype(np.float64)

    def search(self, asked: np.ndarray, cells: list[np.ndarray], q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k best rows in each query's buckets."""
        begin = [np.searchsorted(self.cells, c) for c in cells]
        end = [np.searchsorted(self.cells, c, "right") for c in cells]
        met = sum(int((b - a).sum()) for a, b in zip(begin, end, strict=True))
        # Where buckets cover much of the shard, one product for all is cheaper than picking their rows.
        near = q @ self.matrix.T if 8 * met > len(q) * len(self.ids) else None
        for j, query in enumerate(asked.tolist()):
            size = end[j] - begin[j]
            rows = np.repeat(begin[j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row = near[j, rows] if near is not None else self.matrix[rows] @ q[j]
            if len(row) > k + 1:
                # All that could be among the k best besides the query itself, whatever the rounding.
                bar = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                rows = rows[row >= bar - 1e-9 * max(1.0, abs(bar))]
            rows = rows[self.ids[rows] != query]
            scores, found = (self.matrix[rows] * q[j]).sum(axis=1), self.ids[rows]
            order = _best(scores, found, k)
            yield query, found[order], scores[order]


@lean
def _rank(batches: Iterator[pa.RecordBatch], k: int, wide: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, index rows before queries; one shard is held at a time."""
    kind = np.float64 if wide else np.float32
    shard, held, made = None, {}, {}

    def vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
        column = batch.column("vector")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        size = np.diff(offsets)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            data = np.frombuffer(column.buffers()[2], np.uint8)
            x = data[offsets[rows][:, None] + np.arange(n)].view(kind)
            yield n // kind().itemsize, ids[rows], x, batch.column("cells").take(pa.array(rows))

    for whole in batches:
        own = whole.column("shard").to_numpy(zero_copy_only=False) * 2 + whole.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = whole.slice(a, b - a)
            place, asks = divmod(int(own[a]), 2)
            if place != shard:
                shard, held, made = place, {}, {}
            if not asks:
                for dim, ids, x, cells in vectors(part):
                    lists = held.setdefault(dim, ([], [], []))
                    lists[0].append(np.frombuffer(b"".join(cells.to_pylist()), np.int64))
                    lists[1].append(ids)
                    lists[2].append(x)
                continue
            for dim, ids, x, cells in vectors(part):
                if dim not in held:
                    continue
                if dim not in made:
                    made[dim] = _Shard(*held[dim])
                for i in range(0, len(ids), ASK_AT_ONCE):
                    asked = [np.frombuffer(c, np.int64) for c in cells.slice(i, ASK_AT_ONCE).to_pylist()]
                    found = list(made[dim].search(ids[i : i + ASK_AT_ONCE], asked, x[i : i + ASK_AT_ONCE].astype(np.float64), k))
                    who = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], schema=schema)


def fit_probes(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, functions: int, largest: float, k: int) -> np.ndarray:
    """For each true neighbour of the queries in ``x`` the probes a table that find it; more than MOST_PROBES: none do."""
    hashes = Hashes(x.shape[1], functions)
    cells = np.floor(hashes.place(augmented(x, largest, False))).astype(np.int64)
    at = hashes.place(augmented(q, largest, True))
    home = np.floor(at).astype(np.int64)
    scores = q @ x.T
    scores[ids[None, :] == asked[:, None]] = -np.inf
    base = 3 ** np.arange(functions)
    out = []
    for t in range(TABLES):
        moves = probe_moves(at[:, t] - home[:, t], MOST_PROBES)
        codes = ((moves + 1) * base).sum(axis=2)
        out.append((codes, moves.shape[1]))
    ranks = []
    for j, query in enumerate(asked.tolist()):
        near = _best(scores[j], ids, min(k, int((ids != query).sum())))
        near = near[np.isfinite(scores[j][near])]
        least = np.full(len(near), MOST_PROBES + 1)
        for t, (codes, count) in enumerate(out):
            rank = np.full(3**functions, MOST_PROBES + 1)
            rank[codes[j]] = np.arange(1, count + 1)
            away = cells[near, t] - home[j, t]
            one_step = (np.abs(away) <= 1).all(axis=1)
            least[one_step] = np.minimum(least[one_step], rank[((away[one_step] + 1) * base).sum(axis=1)])
        ranks.append(least)
    return np.concatenate(ranks) if ranks else np.zeros(0, np.int64)


@lean
def _fit(batches: Iterator[pa.RecordBatch], functions: int, largest: float, k: int, target: float) -> Iterator[pa.RecordBatch]:
    """(functions, probes): as many functions as let MOST_PROBES find ``target`` of the neighbours, and the fewest probes."""
    rows: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        asks, ids = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
        for at, x in _vectors(batch.column("vector")):
            for kind in (0, 1):
                own = at[asks[at] == bool(kind)]
                if len(own):
                    rows.setdefault(x.shape[1], [[], [], [], []])[2 * kind].append(ids[own])
                    rows[x.shape[1]][2 * kind + 1].append(x[asks[at] == bool(kind)].astype(float))
    samples = [[np.concatenate(part) for part in own] for own in rows.values() if all(own)]
    while True:
        ranks = np.sort(np.concatenate([np.zeros(0, np.int64), *(fit_probes(*own, functions, largest, k) for own in samples)]))
        probes = int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) if len(ranks) else 1
        if probes <= MOST_PROBES or functions == 1:
            break
        functions -= 1
    yield pa.RecordBatch.from_arrays([pa.array([functions], pa.int32()), pa.array([min(probes, MOST_PROBES)], pa.int32())], names=["functions", "probes"])


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every query its ``k`` found candidates of largest
    inner product (double precision), a query's own id excluded, ties to the smaller id.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no
    part; vectors meet only those of their own length. A query whose buckets hold fewer
    than ``k`` candidates gets its exact neighbours (all of them, if fewer). Of rows of
    ``queries`` with one id the smallest vector asks; an id that ``index`` holds with
    several vectors counts once, with its best. Empty tables give no rows; other columns
    are ignored.
    """
    spark: SparkSession = index.sparkSession
    sound = F.expr(f"size({vector}) > 0 and forall({vector}, x -> x is not null and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)")
    wide = any(dict(df.dtypes)[vector] != "array<float>" for df in (index, queries))
    kind = "array<double>" if wide else "array<float>"
    clean = lambda df: df.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("vector"))
    asked = staged(clean(queries).groupBy("id").agg(F.min("vector").alias("vector")), "ann-queries")
    # The rank limit is met in each task first, so a very common vector sends a few rows a task.
    copies = Window.partitionBy("vector").orderBy("id")
    rows = staged(clean(index).dropDuplicates(["id", "vector"]).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "ann-index")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).first()
    functions = min(MOST_FUNCTIONS, max(1, round(math.log(max(1.0, head.n / BUCKET_ROWS)) / math.log(SPREAD))))
    largest = float(head.largest or 1.0)
    some = lambda df, n, asks: df.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(n).select(F.lit(asks).alias("asks"), "id", "vector")
    sample = some(rows, FIT_ROWS, False).unionByName(some(asked, FIT_QUERIES, True)).coalesce(1)
    fitted = sample.mapInArrow(partial(_fit, functions=functions, largest=largest, k=k, target=target), "functions int, probes int").collect()
    functions, probes = (fitted[0].functions, fitted[0].probes) if fitted else (functions, 1)

    cells = rows.mapInArrow(partial(_cells, functions=functions, largest=largest), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    # Buckets of more than a shard's rows: there are fewer than rows * TABLES / SHARD_ROWS.
    hot = [(r.cell, math.ceil(r.n / SHARD_ROWS)) for r in cells.where(F.col("n") > SHARD_ROWS).collect()]
    shards = Shards(max(LEAST_SHARDS // TABLES, math.ceil(head.n / SHARD_ROWS)), hot)
    entry = pa.schema([("shard", pa.int32()), ("asks", pa.bool_()), ("id", pa.int64()), ("cells", pa.binary()), ("vector", pa.binary())])
    make = lambda df, n: df.mapInArrow(partial(_entries, functions=functions, largest=largest, probes=n, shards=shards, schema=entry), _ENTRY)
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def ranked(entries: DataFrame, asking: DataFrame, count: int) -> DataFrame:
        both = entries.unionByName(asking).repartitionById(count, "shard").sortWithinPartitions("shard", "asks")
        return both.mapInArrow(partial(_rank, k=k, wide=wide, schema=out), "query_id bigint, vec_id bigint, score double")

    merge = lambda lists: lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = staged(merge(ranked(make(rows, 0), make(asked, probes), shards.count)), "ann-found")
    full = merged.groupBy("query_id").count().where(F.col("count") >= k)
    short = staged(asked.join(full, asked.id == full.query_id, "left_anti"), "ann-short")
    if short.head() is not None:
        parts = max(1, math.ceil(head.n / SHARD_ROWS))
        deal = lambda df, asks: df.mapInArrow(partial(_dealt, parts=parts, asks=asks, schema=entry), _ENTRY)
        merged = merge(merged.unionByName(ranked(deal(rows, False), deal(short, True), parts)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
