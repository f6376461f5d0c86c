"""N-gram Jaccard join by T-occurrence search.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at
least 0.8. A document of ``n`` shingles can only link to one that shares at least
``T`` of them, so of its ``n`` inverted lists the ``n - T + 1`` shortest already
hold every partner (they are merged) and the remaining long ones need only be
probed for the partners found (DivideSkip). This is done at two levels:

1. across the cluster, the short lists of every distinct set are merged by a
   shuffle on the shingle. Lists are ranked by a count sketch of fixed size, shortest
   first; any ranking gives the same links. Documents met in a list are chained to
   their predecessor, which costs one row per posting however long the list is. A
   task chains the sets of one size that it meets itself, and sends one of them.
2. each chained group is a cell of bounded size. In a cell the full inverted lists
   are built and searched: heap-merge the short lists, drop candidates below
   ``T - L`` occurrences or already connected, binary-probe the ``L`` long lists, and
   test ``100 * shared >= 80 * union`` exactly.

Where the sketch can't tell common shingles from rare ones, they chain documents that
have little in common, and groups grow. A group beyond a cell is therefore chained
anew with the exact counts of its shingles: those in no other of its sets, and then
the rarest, come first, so a passage that half the group holds no longer counts. What
is still beyond a cell is dealt over block-against-block cells, which together hold
every pair.

Cells report a spanning forest of the links, never all pairs. Equal sets are one node.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, small, staged
from .graph import components
from .words import Words, blocks, mix, shingle_sets, utf8

WIDTH = 5
PERCENT = 80
SKETCH_BITS = 21
SKETCH_PART_BITS = 14
CELL_SHINGLES = 1_500_000
#: Postings that are merged one by one off a heap; more are merged run by run.
HEAP_ENTRIES = 256
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1
_U = np.uint64
_KEY_BITS = 57


def _set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit identity of each set, from two sums over its shingles (0 when empty)."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)))
    sums = total[offsets[1:]] - total[offsets[:-1]]
    return np.where(offsets[1:] > offsets[:-1], mix(sums), _U(0)).view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    for first, last in blocks(offsets):
        yield first, last, *shingle_sets(Words(data, offsets, first, last), width)


@lean
def _describe(batches: Iterator[pa.RecordBatch], width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per document (doc_id, n, sid); at the end the task's shingle counts, in parts."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    none = lambda k, kind: pa.nulls(k, kind)
    for batch in batches:
        sizes, ids = [], []
        for _, _, hashes, offsets in _sets(batch, width):
            counts += np.bincount(hashes >> _U(64 - SKETCH_BITS), minlength=len(counts)).astype(np.uint32)
            sizes.append(np.diff(offsets))
            ids.append(_set_ids(hashes, offsets))
        k = batch.num_rows
        if k:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(ids)), none(k, pa.int32()), none(k, pa.binary())], schema=schema)
    step = 1 << SKETCH_PART_BITS
    kept = np.minimum(counts, 65535).astype("<u2").reshape(-1, step)
    used = np.flatnonzero(kept.any(axis=1))
    if len(used):
        k = len(used)
        yield pa.RecordBatch.from_arrays([none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int64()), pa.array(used.astype(np.int32)), pa.array([kept[i].tobytes() for i in used], pa.binary())], schema=schema)


def _add_parts(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each sketch part; a task holds the parts dealt to it, of a fixed total size.

    Ranks are steps of an eighth of an octave around the mean count: fine enough to
    tell a list that is a little longer than chance has it, whatever the input's size.
    """
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(counts, "<u2").astype(np.uint64)
            sums[part] = sums[part] + own if part in sums else own
    rank = lambda c: np.clip(np.round(8 * np.log2(np.maximum(c, 1) / mean)) + 24, 0, 127).astype(np.uint8)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([rank(c).tobytes() for c in sums.values()], pa.binary())], names=["part", "ranks"])


def _list_ranks(described: DataFrame) -> np.ndarray:
    """Rank of the estimated list length by the leading hash bits: 2**21 bytes, whatever the input."""
    shingles = described.agg(F.sum("n")).first()[0] or 1
    add = partial(_add_parts, mean=shingles / (1 << SKETCH_BITS))
    parts = described.where("part is not null").select("part", "counts").repartition(16, "part").mapInArrow(add, "part int, ranks binary")
    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    step = 1 << SKETCH_PART_BITS
    for row in parts.toLocalIterator():
        ranks[row.part * step : (row.part + 1) * step] = np.frombuffer(row.ranks, np.uint8)
    return ranks


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many of its shortest lists a set of ``n`` looks partners up in, and in how many a larger partner must find it."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _chained_here(keys: np.ndarray, n: np.ndarray, sid: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(postings to send, links (n, sid, sid)) of one task's postings.

    Sets of one size in one list all chain to the first of them that counts as a
    smaller partner, and only that one is sent; sets without such a one are all sent.
    """
    order = np.lexsort((sid, ~low, n, keys))
    keys, n, sid, low = keys[order], n[order], sid[order], low[order]
    fresh = np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (n[1:] != n[:-1])))
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(keys) else np.zeros(0, np.int64)
    inner = ~fresh & low[head]
    links = np.unique(np.stack((n[inner], sid[head][inner], sid[inner]), axis=1), axis=0) if inner.any() else np.zeros((0, 3), np.int64)
    return order[~inner], tuple(links.T)


@lean
def _short_lists(batches: Iterator[pa.RecordBatch], width: int, percent: int, ranks, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Postings of the shortest ``n - T + 1`` lists of each set not yet seen by this task, and links (``other``) made on the way.

    ``low`` marks those that also count when the partner is the larger set.
    """
    ranks, seen = ranks.value, set()
    for batch in batches:
        parts: list[tuple[np.ndarray, int, int, int]] = []
        for _, _, hashes, offsets in _sets(batch, width):
            ids, sizes = _set_ids(hashes, offsets), np.diff(offsets)
            keys = (ranks[hashes >> _U(64 - SKETCH_BITS)].astype(np.uint64) << _U(_KEY_BITS)) | (hashes & _U((1 << _KEY_BITS) - 1))
            for d in np.flatnonzero(sizes):
                n, sid = int(sizes[d]), int(ids[d])
                if (n, sid) in seen:
                    continue
                seen.add((n, sid))
                probe, index = prefix_sizes(n, percent)
                own = keys[offsets[d] : offsets[d + 1]]
                own = np.sort(np.partition(own, probe - 1)[:probe]) if probe < n else np.sort(own)
                parts.append((own, n, sid, index))
        if not parts:
            continue
        lengths = [len(x[0]) for x in parts]
        spread = lambda k: np.repeat(np.array([x[k] for x in parts], np.int64), lengths)  # noqa: E731, B023
        low = np.concatenate([np.arange(m) < x[3] for m, x in zip(lengths, parts, strict=True)])
        key, n, sid = np.concatenate([x[0] for x in parts]).view(np.int64), spread(1), spread(2)
        sent, links = _chained_here(key, n, sid, low)
        yield pa.RecordBatch.from_arrays([pa.array(key[sent]), pa.array(n[sent]), pa.array(sid[sent]), pa.array(low[sent]), pa.nulls(len(sent), pa.int64())], schema=schema)
        if len(links[0]):
            none = len(links[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.array(links[0]), pa.array(links[2]), pa.nulls(none, pa.bool_()), pa.array(links[1])], schema=schema)


def _chain(postings: DataFrame, percent: int) -> DataFrame:
    """Edges between sets that meet in a short list: each to the nearest smaller one that counts, if sizes allow.

    Rows with ``other`` are links that a task made itself, to a set of the same size.
    """
    met = (
        "last(if(low, struct(n, sid), null), true) over "
        "(partition by key order by n, sid, low desc rows between unbounded preceding and 1 preceding)"
    )
    return (
        postings.withColumn("near", F.when(F.col("other").isNotNull(), F.struct("n", F.col("other").alias("sid"))).otherwise(F.expr(met)))
        .where(F.col("near").isNotNull() & (F.lit(100) * F.col("near.n") >= F.lit(percent) * F.col("n")))
        .where("near.n <> n or near.sid <> sid")
        .select(F.col("near.n").alias("n_a"), F.col("near.sid").alias("sid_a"), F.col("n").alias("n_b"), F.col("sid").alias("sid_b"))
        .distinct()
    )


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One ascending array of several. Few entries come off a heap one by one; else the two shortest runs come off, and their merger goes back."""
    if sum(map(len, runs)) <= HEAP_ENTRIES:
        return np.fromiter(heapq.merge(*(r.tolist() for r in runs)), np.int64)
    heap = [(len(r), i, r) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (m, i, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        out, taken = np.empty(m + n, a.dtype), np.zeros(m + n, bool)
        taken[np.searchsorted(b, a, "right") + np.arange(m)] = True
        out[taken], out[~taken] = a, b
        heapq.heappush(heap, (m + n, i, out))
    return heap[0][2] if heap else np.zeros(0, np.int64)


def t_occurrence_links(sets: list[np.ndarray], sides: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest, over positions in ``sets``, of the pairs with Jaccard >= percent/100.

    ``sets``: ascending distinct uint64, ordered by size. ``sides``: 0 is only looked
    up, 1 only searches, 2 both; a pair is considered if one of it searches and the
    other is looked up.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    tokens = np.concatenate(sets) if count else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(count, dtype=np.int32), sizes)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
    lengths = np.diff(np.concatenate((head, [len(ordered)])))
    list_of = np.empty(len(tokens), np.int64)
    list_of[order] = np.repeat(np.arange(len(head)), lengths)
    postings = owner[order]
    root = np.arange(count)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for x in range(count):
        n = int(sizes[x])
        own = list_of[offsets[x] : offsets[x + 1]]
        own = own[lengths[own] > 1]
        least = -(-percent * n // 100)
        if len(own) < least:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        longest = int(lengths[own[-1]])
        skip = min(int(least / (0.0085 * math.log2(longest) + 1)), least - 1)
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        # Merge the short lists, up to this set, and count how often each document occurs.
        runs = [postings[a : a + m] for a, m in zip(head[short].tolist(), lengths[short].tolist(), strict=True)]
        runs = [r[:m] for r, m in zip(runs, [int(np.searchsorted(r, x)) for r in runs], strict=True) if m]
        if not runs:
            continue
        merged = merged_runs(runs)
        first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, times = merged[first], np.diff(np.concatenate((first, [len(merged)])))
        need = -(-percent * (n + sizes[found]) // (100 + percent))
        good = (times >= need - skip) & (100 * sizes[found] >= percent * n) & ((sides[found] | sides[x]) > 0) & ~((sides[found] == 1) & (sides[x] == 1))
        long = np.sort(long)
        for y, t, least_y in zip(found[good].tolist(), times[good].tolist(), need[good].tolist(), strict=True):
            a, b = find(x), find(y)
            if a == b:
                continue
            if len(long):
                theirs = np.sort(list_of[offsets[y] : offsets[y + 1]])
                place = np.searchsorted(theirs, long)
                place[place == len(theirs)] = 0
                t += int((theirs[place] == long).sum())
            if t >= least_y and 100 * t >= percent * (n + int(sizes[y]) - t):
                root[max(a, b)] = min(a, b)
                forest.append((y, x))
    return forest


@lean
def _search_cells(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell and size; one cell is held at a time."""
    cell, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            forest = t_occurrence_links([np.frombuffer(s, np.uint64) for _, s, _ in held], np.array([side for _, _, side in held], np.int8), percent)
            if forest:
                nodes = [node for node, _, _ in held]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in forest], pa.int64()), pa.array([nodes[j] for _, j in forest], pa.int64())], schema=schema)

    for batch in batches:
        for own, node, items, side in zip(*(batch.column(k).to_pylist() for k in ("cell", "node", "items", "side")), strict=True):
            if own != cell:
                yield from flush()
                cell, held = own, []
            if not held or held[-1][0] != node:  # a repeated row
                held.append((node, items, side))
    yield from flush()


@lean
def _full_sets(batches: Iterator[pa.RecordBatch], width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, n, sid, items) of each document, repeated rows of a task once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for first, last, hashes, offsets in _sets(batch, width):
            rows = []
            for id_, sid, a, b in zip(batch.column("id").slice(first, last - first).to_pylist(), _set_ids(hashes, offsets).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if (id_, sid) not in seen:
                    seen.add((id_, sid))
                    rows.append((id_, b - a, sid, hashes[a:b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@lean
def _all_postings(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group, n, sid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "n", "sid"))
        for i, items in enumerate(batch.column("items").to_pylist()):
            own = np.frombuffer(items, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x[i])) for x in (group, n, sid)] + [pa.array(own)], schema=schema)


def exact_chain(sets: DataFrame, percent: int) -> DataFrame:
    """Edges as ``_chain`` makes them, for ``sets(group, n, sid, items)``, lists ranked by their exact length within the group.

    A shingle that no other set of the group holds has no list to look up; such shingles
    fill a set's first places. Only the others are put in order.
    """
    schema = pa.schema([("group", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("shingle", pa.int64())])
    every = sets.select("group", "n", "sid", "items").mapInArrow(partial(_all_postings, schema=schema), "group bigint, n bigint, sid bigint, shingle bigint")
    shared = every.groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = every.join(shared, ["group", "shingle"])
    own = Window.partitionBy("group", "n", "sid")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "shingle"))
    least = lambda over: f"n - cast(ceil({percent if over == 100 else 2 * percent} * n / {over}) as bigint) + 1"
    kept = rows.withColumn("place", place).where(F.col("place") <= F.expr(least(100))).withColumn("low", F.col("place") <= F.expr(least(100 + percent)))
    return _chain(kept.select(F.xxhash64("group", "shingle").alias("key"), "n", "sid", "low", F.lit(None).cast("bigint").alias("other")), percent)


def _cells(nodes: DataFrame, cell_shingles: int) -> DataFrame:
    """(node, cell, side) from (node, n, group): small groups whole, larger ones block against block.

    Blocks are of one size class (sizes within a factor of 1.26), and meet blocks of
    their own and the next class: partners' sizes differ by 1.25 at most.
    """
    sized = nodes.withColumn("class", F.floor(F.log("n") / F.lit(math.log(1.26))).cast("int"))
    per_class = sized.groupBy("group", "class").agg(F.sum("n").alias("weight"))
    total = per_class.groupBy("group").agg(F.sum("weight").alias("total"))
    deal = per_class.withColumn("k", F.ceil(F.col("weight") / F.lit(cell_shingles)).cast("int"))
    up = deal.select("group", (F.col("class") - 1).alias("class"), F.col("k").alias("k_up"))
    down = deal.select("group", (F.col("class") + 1).alias("class"), F.col("k").alias("k_down"))
    deal = deal.join(up, ["group", "class"], "left").join(down, ["group", "class"], "left").join(total, "group")
    placed = sized.join(deal, ["group", "class"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    whole = F.col("total") <= F.lit(cell_shingles)
    one = placed.where(whole).select("node", F.xxhash64("group").alias("cell"), F.lit(2).cast("tinyint").alias("side"))
    cell = lambda c, i, d, j: f"xxhash64(group, {c}, {i}, {d}, {j})"
    spread = F.expr(
        "concat("
        f" transform(sequence(0, k - 1), j -> struct({cell('class', 'least(b, j)', 'class', 'greatest(b, j)')} as cell, cast(case when j = b then 2 when j > b then 0 else 1 end as tinyint) as side)),"
        f" if(k_up is null, array(), transform(sequence(0, coalesce(k_up, 1) - 1), j -> struct({cell('class', 'b', 'class + 1', 'j')} as cell, cast(0 as tinyint) as side))),"
        f" if(k_down is null, array(), transform(sequence(0, coalesce(k_down, 1) - 1), j -> struct({cell('class - 1', 'j', 'class', 'b')} as cell, cast(1 as tinyint) as side)))"
        ")"
    )
    many = placed.where(~whole).select("node", F.explode(spread).alias("s")).select("node", "s.cell", "s.side")
    return one.union(many)


def _grouped(met: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    """(node, id, n, sid, group) of the sets that ``met`` joins to others."""
    sets = lambda end: reps.select(F.col("n").alias(f"n_{end}"), F.col("sid").alias(f"sid_{end}"), F.col("node").alias(end))
    edges = met.join(sets("a"), ["n_a", "sid_a"]).join(sets("b"), ["n_b", "sid_b"]).select("a", "b")
    return components(edges, name).join(reps, "node").select("node", "id", "n", "sid", F.col("component").alias("group"))


def near_duplicate_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cell_shingles: int = CELL_SHINGLES, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, component_id, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the document's own
    included. Null or wordless text: no shingles, linked with nothing. Rows that
    repeat a doc_id are documents of their own; a null doc_id links as any other, but
    counts as absent when a component's smallest id is taken (null if there is no
    other). An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    pa_described = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
    described = staged(texts.mapInArrow(partial(_describe, width=width, schema=pa_described), "doc_id bigint, n bigint, sid bigint, part int, counts binary"), "shingle-sets")
    members = described.where("part is null").select("doc_id", "n", "sid")
    ranks = spark.sparkContext.broadcast(_list_ranks(described))

    pa_postings = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("low", pa.bool_()), ("other", pa.int64())])
    listed = texts.mapInArrow(partial(_short_lists, width=width, percent=percent, ranks=ranks, schema=pa_postings), "key bigint, n bigint, sid bigint, low boolean, other bigint")
    # Links that tasks made themselves pass along with the postings, in lists of their own.
    met = staged(_chain(listed.withColumn("key", F.coalesce("key", F.xxhash64("n", "sid", "other"))), percent), "met")

    # Every distinct set has a number, and the smallest doc_id that has it.
    sets = members.where("n > 0").groupBy("n", "sid").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"))
    reps = staged(sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    nodes = staged(_grouped(met, reps, "groups"), "nodes")
    by_id = texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    pa_sets = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("items", pa.binary())])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """wanted's columns and items; small tables go to the texts, so that these stay where they are."""
        keyed = small(wanted, 120)
        made = by_id.join(keyed.select("id"), "id", "left_semi").mapInArrow(partial(_full_sets, width=width, schema=pa_sets), "id bigint, n bigint, sid bigint, items binary")
        return made.join(keyed, ["id", "n", "sid"])

    over = nodes.groupBy("group").agg(F.sum("n").alias("total")).where(F.col("total") > cell_shingles).select("group")
    large = staged(nodes.join(small(over, 40), "group"), "large-groups")
    if large.head() is not None:
        anew = _grouped(staged(exact_chain(sets_of(large).dropDuplicates(["n", "sid"]), percent), "met-exactly"), reps, "groups-anew")
        nodes = staged(nodes.join(large.select("node"), "node", "left_anti").unionByName(anew.select(*nodes.columns)), "nodes-anew")
    cells = staged(_cells(nodes.select("node", "n", "group"), cell_shingles), "cells")

    pa_links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    links = (
        sets_of(nodes).drop("group").join(small(cells, 100), "node")
        .select("cell", "node", "n", "items", "side")
        .repartition(shuffle_partitions(spark), "cell")
        .sortWithinPartitions("cell", "n", "node")
        .mapInArrow(partial(_search_cells, percent=percent, schema=pa_links), "a bigint, b bigint")
    )
    linked = staged(components(links, "links").join(reps.select("node", "n", "sid", "id"), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    class_of = linked.join(least, "component").select("n", "sid", F.nullif("least", F.lit(NO_ID)).alias("least"))
    # Sets without a link keep their members' smallest id; rows that share a set are one class.
    alone = reps.join(linked.select("node"), "node", "left_anti").select("n", "sid", F.nullif("id", F.lit(NO_ID)).alias("least"))
    return members.join(class_of.unionByName(alone), ["n", "sid"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first (smallest doc_id) of their component; null ids stay.

    Rows that share the first's id stay with it. Columns and repeated rows stay as they are.
    """
    classes = near_duplicate_components(docs, **options)
    gone = staged(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(small(gone, 60), docs["doc_id"] == F.col("gone_id"), "left_anti")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for all of ``documents``."""
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
