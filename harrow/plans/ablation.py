"""The ablation: which stage of retrieval contributes what, on one set of queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import search as S
from ..options import RetrievalOptions
from ..staging import stage

BASELINE = "Hybrid (RRF)"


@dataclass(frozen=True)
class Configuration:
    name: str
    options: RetrievalOptions
    is_default: bool = False


# The rows of the ablation by name: whether each branch searches, how many clusters are routed to, whether MMR re-ranks.
ROWS = {
    "Dense only": (True, False, 0, False),
    "BM25 only": (False, True, 0, False),
    "Hybrid (RRF)": (True, True, 0, False),
    "Hybrid + routing (m=1)": (True, True, 1, False),
    "Hybrid + routing (m=3)": (True, True, 3, False),
    "Hybrid + MMR": (True, True, 0, True),
    "Hybrid + routing (m=3) + MMR": (True, True, 3, True),
}
# Fixed value: the weight of relevance in MMR where the defaults have none.
WEIGHT = 0.7


def ablation_configs(defaults: RetrievalOptions, k: int) -> list[Configuration]:
    """The ``ROWS`` at depth ``k``; the defaults are one of them (marked), or come last."""
    sized = replace(defaults, top_k=k, candidate_pool=max(k, defaults.candidate_pool))
    lists = sized.mmr_lambda if sized.mmr_lambda is not None else WEIGHT

    def switched(dense: bool, sparse: bool, clusters: int, rerank: bool) -> RetrievalOptions:
        return replace(sized, use_dense=dense, use_sparse=sparse, route_top_m=clusters, mmr_lambda=lists if rerank else None)

    made = {name: switched(*stages) for name, stages in ROWS.items()}
    if sized not in made.values():
        made["Shipped default"] = sized
    return [Configuration(name, options, options == sized) for name, options in made.items()]


def run_configs(queries: DataFrame, chunks: DataFrame, configs: list[Configuration], centroids: DataFrame | None = None, id_col: str = "doc_id", sparse: DataFrame | None = None) -> DataFrame:
    """(config, query_id, rank, id, score) of all configurations.

    The unrestricted dense list and the lexical list are made once, at the greatest
    depth asked for, and shared; ``sparse`` is a lexical list made before.
    """
    depth = max(max(c.options.prefetch_limit, c.options.limit) for c in configs)
    dense = stage(S.dense_topk(queries, chunks, depth, id_col=id_col))
    sparse = stage(sparse.where(F.col("rank") <= depth) if sparse is not None else S.bm25_topk(queries, chunks, depth, id_col=id_col))
    lists = [S.retrieve(queries, chunks, c.options, centroids, id_col, sparse, dense).select(F.lit(c.name).alias("config"), "query_id", "rank", id_col, "score") for c in configs]
    return reduce(DataFrame.unionByName, lists)


def evaluate(
    queries: DataFrame, chunks: DataFrame, relevant: DataFrame, k: int = 10, defaults: RetrievalOptions | None = None, centroids: DataFrame | None = None, canonical: DataFrame | None = None, sparse: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Scores per query, summaries with intervals, deltas to the hybrid row, means by source.

    ``queries``: query_id, text, dense, source. ``relevant``: query_id, doc_id.
    ``canonical``: (doc_id, canonical) of what the chunks' ids stand for, where that
    isn't themselves: a chunk's document, a mirror's original.
    """
    configs = ablation_configs(defaults or RetrievalOptions(), k)
    results = stage(run_configs(queries, chunks, configs, centroids, sparse=sparse))
    judged = results if canonical is None else results.join(canonical, "doc_id").select("config", "query_id", "rank", F.col("canonical").alias("doc_id"))
    scores = M.score_rankings(judged, relevant, k).join(M.intra_list_similarity(results, chunks, k), ["config", "query_id"], "left")
    scores = stage(scores)
    ci = M.bootstrap_ci(scores, "ndcg_at_k").select("config", F.struct("lo", "hi").alias("ndcg_ci"))
    deltas = M.paired_delta(scores, BASELINE)
    delta_ci = M.bootstrap_ci(deltas, "delta").select("config", F.col("mean").alias("delta"), F.struct("lo", "hi").alias("delta_ci"))
    means = M.summarize(scores, metrics=("ndcg_at_k", "recall_at_5", "recall_at_k", "mrr_at_k", "distinct_docs", "ils"))
    by_source = M.summarize(scores.join(queries.select("query_id", "source"), "query_id"), ("config", "source"), ("ndcg_at_k", "recall_at_k"))
    return {"results": results, "scores": scores, "summary": means.join(ci, "config").join(delta_ci, "config"), "by_source": by_source}


def batch_latency(queries: DataFrame, chunks: DataFrame, config: Configuration, centroids: DataFrame | None = None, sparse: Callable[[int], DataFrame] | None = None) -> float:
    """Milliseconds a query, amortised over the batch; not comparable with a service's median.

    ``sparse`` makes the lexical list to a depth, where results come from such a one.
    """
    begun, o = time.monotonic(), config.options
    lists = sparse(o.prefetch_limit if o.use_dense else o.limit) if sparse is not None and o.use_sparse else None
    S.retrieve(queries, chunks, o, centroids, sparse=lists).write.format("noop").mode("overwrite").save()
    return round(1000 * (time.monotonic() - begun) / max(1, queries.count()), 2)
