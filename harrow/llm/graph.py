"""Connected components of an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable over ``edges(a, b)``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each node's
    minimum is a map-side combined aggregate, so a hub's edges are never gathered.
    Every round is a staged table. Nodes without an edge don't appear; nulls and
    loops are ignored; an empty table gives an empty result.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = staged(edges, f"{name}-edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(edges)
    for _ in range(max_rounds):
        both = _both(edges)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.where("a < b")
        parent = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(parent, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        after = staged(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-round")
        now = mark(after)
        done, edges, before = now == before, after, now
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
