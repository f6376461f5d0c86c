"""Mixing sources to target weights by temperature.

Source token shares ``p`` become weights proportional to ``p ** a``. The exponent
``a`` in [0, 1] (0: uniform, 1: as they are) is found by bisection, five halvings a
pass over the table of source totals: the smallest that keeps the weights' entropy at
or below the target and no source above the repetition limit. Nothing but the sums
for the points tried comes to the driver.

The weights are realised as budgeted block permutations. Each source's documents are
dealt into blocks; an epoch is a pseudo-random order of its blocks and of the
documents in them. A source with a budget of 1.3 times its tokens is read once whole,
then a second order up to the block where the budget ends, and in that block up to
the last document that fits. Running totals over blocks are taken in two levels
(1,024 stretches of the order, then blocks in a stretch), so the largest source is no
single task's work.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, staged

BLOCK_TOKENS = 1 << 16
MAX_REPETITION = 1.5
_POINTS = 31
_PASSES = 9


def count_words(text: str = "text"):
    """Tokens by white space; null has none."""
    return F.expr(f"cast(coalesce(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) as bigint)")


def _sums(shares: DataFrame, points: list[float]) -> list[tuple[float, float, float]]:
    """(sum p^a, sum p^a ln p, largest p^(a-1)) at each point."""
    aggs = []
    for i, a in enumerate(points):
        power = F.pow("p", F.lit(a))
        aggs += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("p")).alias(f"l{i}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"r{i}")]
    row = shares.agg(*aggs).first()
    return [(row[f"z{i}"], row[f"l{i}"], row[f"r{i}"]) for i in range(len(points))]


def _entropy(a: float, z: float, lp: float) -> float:
    return math.log(z) - a * lp / z


def bisect_exponent(shares: DataFrame, fits: Callable[[float, float, float, float], bool]) -> float:
    """The smallest exponent in [0, 1] whose sums fit; 1 if none does. ``fits`` must stay true once true."""
    low, high = 0.0, 1.0
    if fits(0.0, *_sums(shares, [0.0])[0]):
        return 0.0
    for _ in range(_PASSES):
        points = [low + (high - low) * (i + 1) / (_POINTS + 1) for i in range(_POINTS)]
        good = [fits(a, *s) for a, s in zip(points, _sums(shares, points), strict=True)]
        k = good.index(True) if True in good else _POINTS
        low, high = (points[k - 1] if k else low), (points[k] if k < _POINTS else high)
    return high


def mix_sources(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 17,
    block_tokens: int = BLOCK_TOKENS,
    tokens: str | None = None,
    source: str = "source",
) -> DataFrame:
    """``docs`` with one row per copy that the mixture holds, and tokens, weight, epoch,
    block, block_key, doc_key (columns of these names are replaced).

    Sorted by (source, epoch, block_key, doc_key) the rows of a source are its block
    permutations. ``budget``: tokens in all; by default the largest at which the most
    reduced source is still read once whole, so no document is lost and the others
    repeat, at most ``max_repetition`` times. ``tokens``: a column of counts (default:
    words). Null sources are one source. Documents without tokens are kept once.
    Repeated rows count as documents of their own. No rows: no rows.
    """
    spark: SparkSession = docs.sparkSession
    own = {"tokens": F.coalesce(F.col(tokens), F.lit(0)).cast("bigint") if tokens else count_words()}
    kept = [c for c in docs.columns if c not in ("weight", "epoch", "block", "block_key", "doc_key")]
    # Rows without an id are told apart by their place in the input.
    own_id = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())] if "doc_id" in docs.columns else [F.monotonically_increasing_id()]
    ids = F.xxhash64(F.lit(seed), *own_id, *[F.col(c) for c in ("text",) if c in docs.columns])
    rows = docs.select(*kept).withColumns(own | {"doc_key": ids, "harrow_source": F.coalesce(F.col(source).cast("string"), F.lit("\x00null"))})

    by_source = staged(rows.groupBy("harrow_source").agg(F.sum("tokens").alias("t")), "source-tokens")
    head = by_source.agg(F.sum("t").alias("all"), F.max("t").alias("most")).first()
    everything, most = head["all"] or 0, head["most"] or 0
    shares = by_source.where("t > 0").select("harrow_source", "t", (F.col("t") / F.lit(float(max(everything, 1)))).alias("p"))

    def fits(a: float, z: float, lp: float, repeat: float) -> bool:
        tokens_out = budget if budget is not None else most / ((most / everything) ** a / z)
        calm = max_repetition is None or repeat / z * tokens_out / everything <= max_repetition * (1 + 1e-12)
        return calm and (target_entropy is None or _entropy(a, z, lp) <= target_entropy + 1e-12)

    exponent, z = 1.0, 1.0
    if everything:
        exponent = bisect_exponent(shares, fits)
        z = _sums(shares, [exponent])[0][0]
    tokens_out = budget if budget is not None else (most / ((most / everything) ** exponent / z) if everything else 0)

    blocks = max(1, math.ceil(most / block_tokens))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_key"), F.lit(blocks)))
    weight = F.pow("p", F.lit(exponent)) / F.lit(z)
    # The largest source's budget is its tokens exactly; rounding must not cost it a document.
    plan = shares.withColumns({"weight": weight, "due": F.round(weight * F.lit(float(tokens_out)) + F.lit(1e-6)).cast("bigint")})
    plan = plan.withColumns({"whole": F.floor(F.col("due") / F.col("t")), "rest": F.col("due") % F.col("t")}).select("harrow_source", "weight", "whole", "rest")
    key = F.xxhash64(F.lit(seed + 2), "whole", "harrow_source", "block")
    dealt = rows.groupBy("harrow_source", "block").agg(F.sum("tokens").alias("own")).join(plan, "harrow_source", "left")
    dealt = dealt.withColumns({"block_key": key, "stretch": F.shiftrightunsigned(key, 54)})
    stretch = dealt.groupBy("harrow_source", "stretch").agg(F.sum("own").alias("stretch_own"))
    before = lambda *by: Window.partitionBy("harrow_source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.withColumn("stretch_before", F.coalesce(F.sum("stretch_own").over(before("stretch")), F.lit(0))).drop("stretch_own")
    dealt = dealt.join(stretch, ["harrow_source", "stretch"]).withColumn("left", F.col("rest") - F.col("stretch_before") - F.coalesce(F.sum("own").over(before("stretch", "block_key")), F.lit(0)))
    dealt = staged(dealt.select("harrow_source", "block", "weight", "whole", "own", F.greatest("left", F.lit(0)).alias("left")), "mixing-blocks")
    longest = dealt.agg(F.max(F.octet_length("harrow_source"))).first()[0] or 0
    dealt = small(dealt, 120 + longest)

    # The block in which a budget ends is one of a source's; only its documents are put in order.
    joined = rows.join(dealt, ["harrow_source", "block"])
    ends = joined.where("left > 0 and left < own")
    within = Window.partitionBy("harrow_source", "block").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("more", F.when(F.sum("tokens").over(within) <= F.col("left"), 1).otherwise(0))
    rest = joined.where("left <= 0 or left >= own or left is null").withColumn("more", F.when(F.col("left") >= F.col("own"), F.when(F.col("left") > 0, 1).otherwise(0)).otherwise(0))
    both = rest.unionByName(ends).withColumn("copies", F.when(F.col("tokens") > 0, F.coalesce("whole", F.lit(1)) + F.col("more")).otherwise(F.lit(1)))
    out = both.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    out = out.withColumn("block_key", F.xxhash64(F.lit(seed + 2), "epoch", "harrow_source", "block"))
    return out.select(*[c for c in kept if c != "tokens"], "tokens", "weight", "epoch", "block", "block_key", "doc_key")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the default mixture of all ``documents``, with its place in the block permutations."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = staged(docs.select("doc_id", "source", count_words().alias("words")), "words")
    return mix_sources(slim, tokens="words").select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "block_key", "doc_key")
