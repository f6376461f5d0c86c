import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.errors import ConfigurationError
from harrow.functions.arrays import MAXIMUM, running
from harrow.operators import metrics as M
from harrow.operators import search as S
from harrow.operators.synthesis import containing
from harrow.options import RetrievalOptions
from harrow.plans.ablation import ablation_configs


@pytest.mark.parametrize(
    ("relevance", "vectors", "k", "weight", "wanted"),
    [
        ([1, 0.99, 0.9], [[1, 0], [0.999, 0.01], [0, 1]], 2, 0.5, [0, 2]),
        ([0.2, 0.9, 0.5, 0.7], np.eye(4), 4, 1.0, [1, 3, 2, 0]),
        ([1, 0.9, 0.1], [[1, 0], [1, 0.01], [0, 1]], 2, 0.0, [0, 2]),
        ([1.0, 0.5], np.eye(2), 9, 0.5, [0, 1]),
        ([1.0], np.eye(1), 0, 0.5, []),
        ([0.5, 0.5, 0.5], np.eye(3), 3, 0.7, [0, 1, 2]),
    ],
)
def test_mmr_order(relevance, vectors, k, weight, wanted):
    assert S.mmr_order(np.array(relevance, float), np.array(vectors, float), k, weight) == wanted


def test_mmr_needs_a_vector_each():
    with pytest.raises(ValueError):
        S.mmr_order(np.ones(2), np.eye(3), 2, 0.5)


def test_minmax_of_equal_scores_is_one(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (2, "a", 1.0), (2, "b", 3.0)], "query_id int, doc_id string, score double")
    assert sorted((r.query_id, r.doc_id, r.relevance) for r in S.minmax(rows).collect()) == [(1, "a", 1.0), (1, "b", 1.0), (2, "a", 0.0), (2, "b", 1.0)]


def test_dense_topk_with_routing_ties_and_nulls(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [2.0, 0.0], 0), ("c", [0.0, 1.0], 1), ("d", [1.0, 1.0], None), ("e", None, 0)], "doc_id string, dense array<double>, cluster_id int")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id int, dense array<double>")
    found = {(r.query_id, r.rank): r.doc_id for r in S.dense_topk(queries, chunks, 2).collect()}
    assert found == {(1, 1): "a", (1, 2): "b", (2, 1): "c", (2, 2): "d"}
    routed = spark.createDataFrame([(2, 0)], "query_id int, cluster_id int")
    found = {(r.query_id, r.rank): r.doc_id for r in S.dense_topk(queries, chunks, 2, routed).collect()}
    assert found == {(1, 1): "a", (1, 2): "b", (2, 1): "a", (2, 2): "b"}
    assert S.dense_topk(queries.where("false"), chunks, 2).count() == 0


def test_bm25_against_the_formula(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(0, 12))) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    queries = spark.createDataFrame([(1, "Alpha alpha zeta"), (2, "nothing"), (3, None)], "query_id int, text string")
    got = {(r.doc_id): r.score for r in S.bm25_topk(queries, docs, 50).collect()}
    split = {i: t.split() for i, t in texts.items()}
    avg = sum(map(len, split.values())) / 30
    wanted = {}
    for term in ("alpha", "zeta"):
        df = sum(term in w for w in split.values())
        for i, w in split.items():
            if tf := w.count(term):
                wanted[i] = wanted.get(i, 0) + math.log(1 + (30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    assert got.keys() == wanted.keys() and all(abs(got[i] - wanted[i]) < 1e-9 for i in got)


def test_fusion_favours_what_both_branches_found(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "query_id int, rank int, doc_id string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z")], "query_id int, rank int, doc_id string")
    assert [(r.doc_id, round(r.score, 6)) for r in S.rrf([a, b], 3).orderBy("rank").collect()] == [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]


def _scored(spark, ranking, relevant, k):
    rows = spark.createDataFrame([("c", 1, i, d) for i, d in enumerate(ranking, 1)], "config string, query_id int, rank int, doc_id string")
    truth = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id string")
    return M.score_rankings(rows, truth, k).first()


def test_metrics_by_hand(spark):
    one = _scored(spark, "abbc", "b", 10)
    assert (one.first_relevant_rank, one.mrr_at_k, one.distinct_docs) == (2, 0.5, 3) and abs(one.ndcg_at_k - 1 / math.log2(3)) < 1e-12
    two = _scored(spark, "xab", "ab", 3)
    ideal = 1 + 1 / math.log2(3)
    assert two.recall_at_k == 1 and abs(two.ndcg_at_k - (1 / math.log2(3) + 0.5) / ideal) < 1e-12
    mirrored = _scored(spark, "aax", "ab", 10)
    assert mirrored.recall_at_k == 0.5 and abs(mirrored.ndcg_at_k - 1 / ideal) < 1e-12
    assert _scored(spark, "abc", "c", 2).ndcg_at_k == 0
    none = _scored(spark, "abc", "", 3)
    assert none.recall_at_k is None and none.ndcg_at_k == 0


def test_list_similarity_is_the_mean_over_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((6, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id int, dense array<double>")
    rows = spark.createDataFrame([("c", 1, i + 1, i) for i in range(6)] + [("c", 2, 1, 0)], "config string, query_id int, rank int, doc_id int")
    got = {r.query_id: r.ils for r in M.intra_list_similarity(rows, vectors, 4).collect()}
    assert abs(got[1] - np.mean([v[i] @ v[j] for i in range(4) for j in range(i)])) < 1e-12 and got[2] == 0


def test_bootstrap_repeats_and_pairs(spark):
    values = spark.createDataFrame([(c, i, (i % 7) / 7 + shift) for c, shift in (("a", 0.0), ("b", 0.5)) for i in range(50)], "config string, query_id int, v double")
    first = {r.config: r for r in M.bootstrap_ci(values, "v", count=200).collect()}
    again = {r.config: r for r in M.bootstrap_ci(values, "v", count=200).collect()}
    assert first == again and first["a"].lo < first["a"].mean < first["a"].hi
    assert abs(first["b"].lo - first["a"].lo - 0.5) < 1e-9


def test_options():
    assert RetrievalOptions().limit == 40 and RetrievalOptions(mmr_lambda=None).limit == 8
    assert RetrievalOptions().with_overrides(top_k=50, mmr_lambda=None).candidate_pool == 50
    for wrong in ({"use_dense": False, "use_sparse": False}, {"mmr_lambda": 1.5}, {"top_k": 41}, {"top_k": 0}):
        with pytest.raises(ConfigurationError):
            RetrievalOptions(**wrong)
    names = [c.name for c in ablation_configs(RetrievalOptions(), 10)]
    assert len(names) == 7 and [c.name for c in ablation_configs(RetrievalOptions(), 10) if c.is_default] == ["Hybrid + MMR"]
    assert ablation_configs(RetrievalOptions(route_top_m=2), 10)[-1].name == "Shipped default"


def test_retrieve_end_to_end(spark):
    rng = np.random.default_rng(1)
    words = "red green blue stone river cloud".split()
    rows = [(f"d{i}", " ".join(rng.choice(words, 6)), rng.standard_normal(4).tolist(), int(i % 3)) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id string, text string, dense array<double>, cluster_id int")
    queries = spark.createDataFrame([(1, "red river", [1.0, 0.0, 0.0, 0.0]), (2, "cloud", [0.0, 1.0, 0.0, 0.0])], "query_id int, text string, dense array<double>")
    centroids = spark.createDataFrame([(i, np.eye(4)[i].tolist()) for i in range(3)], "cluster_id int, centroid array<double>")
    for options in (RetrievalOptions(top_k=5), RetrievalOptions(top_k=5, route_top_m=1), RetrievalOptions(top_k=5, use_sparse=False, mmr_lambda=None), RetrievalOptions(top_k=5, use_dense=False)):
        found = S.retrieve(queries, chunks, options, centroids).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
        assert [(r.n, r.r) for r in found] == [(5, 5), (5, 5)]


def greedy_mmr(relevance, vectors, k, weight):
    """Every value anew at every step."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    order, left = [], list(range(len(relevance)))
    while left and len(order) < k:
        value = lambda i: round(relevance[i] if not order else weight * relevance[i] - (1 - weight) * max(float(unit[i] @ unit[j]) for j in order), 12)
        order.append(max(left, key=lambda i: (value(i), -i)))
        left.remove(order[-1])
    return order


def test_mmr_equals_the_greedy_order():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, weight = int(rng.integers(1, 25)), float(rng.choice([0.0, 0.3, 0.7, 1.0]))
        vectors = rng.standard_normal((n, 4))
        vectors[rng.integers(0, n, n // 3)] = vectors[0]
        relevance = np.round(rng.random(n), 1)
        assert S.mmr_order(relevance, vectors, 10, weight) == greedy_mmr(relevance, vectors, 10, weight)


def test_many_queries_are_searched_in_bounded_products(spark, monkeypatch):
    monkeypatch.setattr(S, "MATRIX_QUERIES", 900)
    rng = np.random.default_rng(4)
    q, x = rng.standard_normal((2000, 8)), rng.standard_normal((50, 8))
    frame = lambda m, name: spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], f"{name} long, dense array<double>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in S.dense_topk(frame(q, "query_id"), frame(x, "doc_id"), 3).collect()}
    near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    best = np.argsort(-near, axis=1)[:, :3]
    assert len(got) == 6000 and all(got[i, r + 1] == best[i, r] for i in range(2000) for r in range(3))


def test_documents_that_contain_an_item(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(40)]
    bodies = [" ".join(rng.choices(words, k=30)) for _ in range(40)] + ["", "x", None, "A, b; C. d!"]
    whole = [b for b in bodies[:10]]
    parts = [b[rng.randrange(20) : rng.randrange(25, 90)] for b in bodies[:30]]
    texts = whole + parts + ["", None, "b; C", "d", "A, b; C. d!", "zz zz zz zz zz zz"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = sorted((r.query_id, r.doc_id) for r in containing(docs, items).collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, b in enumerate(bodies) if t is not None and b is not None and t in b)


def test_running_values(spark):
    rows = [(i, list(range(n))) for i, n in enumerate([0, 1, 127, 128, 129, 1000])]
    df = spark.createDataFrame(rows, "id int, xs array<int>").selectExpr("id", f"{running('xs', 'e')} as s", f"{running('xs', '(e * 37) % 101', MAXIMUM)} as m")
    for r in df.collect():
        xs = rows[r.id][1]
        assert r.s == [sum(xs[:i]) for i in range(len(xs))]
        assert r.m == [max([0, *((x * 37) % 101 for x in xs[:i])]) for i in range(len(xs))]


def test_tasks_of_lexical_search_hand_on_k_rows_a_query(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('moon rare', id % 7, ' ', repeat('sun ', cast(id % 5 as int))) as text").repartition(3)
    queries = spark.createDataFrame([(i, f"moon rare{i} sun") for i in range(40)], "query_id int, text string")
    handed, ranked = [], S.ranked
    monkeypatch.setattr(S, "ranked", lambda scores, *rest: handed.append(scores) or ranked(scores, *rest))
    found = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in S.bm25_topk(queries, docs, 5).collect()}
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    mean, df = sum(map(len, texts.values())) / len(texts), {t: sum(t in w for w in texts.values()) for t in ["moon", "sun", *(f"rare{i}" for i in range(7))]}
    part = lambda w, t: np.log(1 + (3000 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    for q in (0, 6, 39):
        scores = [(-round(sum(part(w, t) for t in ("moon", f"rare{q}", "sun") if t in df), 9), i) for i, w in texts.items()]
        assert [found[q, r] for r in range(1, 6)] == [(i, -s) for s, i in sorted(scores)[:5]]
    assert handed[0].count() <= 40 * 5 * max(1, handed[0].rdd.getNumPartitions())
