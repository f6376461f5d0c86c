"""All queries of the engine by name, on the test tables.

``documents`` are the corpus, ``benchmark`` items the queries (an item's relevant
documents are those that hold its text), ``embeddings`` chunk vectors with their
label as topic, ``conversations`` documents with sections (a heading for each turn's
role). ``harrow.plans.oracle`` has the SQL twins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import unit
from ..operators import batching, chunking, clustering, index, metrics, search, synthesis
from ..operators.store import IndexStore
from ..options import EmbeddingOptions, RetrievalOptions
from ..staging import stage, stage_path
from . import ablation, evalset
from .oracle import ORACLE_SQL  # noqa: F401

K, POOL, PREFETCH, WEIGHT, M_ROUTED = 10, 40, 100, 0.7, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ inputs


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def titled(spark, sf) -> DataFrame:
    """Documents in corpus form: title ``<source>/<lang>``, metadata source and topic."""
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("topic"), F.col("lang"))
    return documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws("/", "source", "lang").alias("title"), "text", F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_uri"), meta.alias("metadata"))


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked(spark, sf) -> DataFrame:
    """Queries with text and vector."""
    return index.hashed_embedding(items(spark, sf), "query_id", keep=("text",))


def corpus(spark, sf, *keep: str) -> DataFrame:
    """Documents with vector and the cluster of the nearest topic centroid, and the columns to ``keep``; nothing is shuffled."""
    return clustering.with_nearest(index.hashed_embedding(documents(spark, sf), keep=keep), topics(spark, sf)).drop("similarity")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("dense"), F.col("label").alias("cluster_id"))


def topics(spark, sf) -> DataFrame:
    """Centroids: the unit means of the labels."""
    return clustering.lloyd_step(vectors(spark, sf))


def relevant(spark, sf) -> DataFrame:
    """(query_id, doc_id): the documents that hold the item's text."""
    return synthesis.containing(documents(spark, sf), items(spark, sf))


def sectioned(spark, sf) -> DataFrame:
    """Conversations as documents: a heading with the role before each turn."""
    turns = table(spark, sf, "conversations")
    part = F.concat(F.lit("== "), F.col("role"), F.lit(" ==\n"), F.col("text"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


def stored_version(spark, sf) -> DataFrame:
    """What an earlier run indexed: (doc_id, content_hash) of the corpus when its white space was squashed, and of the items."""
    old = titled(spark, sf).withColumn("text", tx.squash("text"))
    gone = items(spark, sf).select(F.concat(F.lit("item:"), F.col("query_id")).alias("doc_id"), F.lit("item").alias("title"), "text")
    return index.with_content_hash(old.select("doc_id", "title", "text").unionByName(gone)).select("doc_id", "content_hash")


# ------------------------------------------------------------- identity, text


@query
def doc_hash(spark, sf):
    return index.with_content_hash(titled(spark, sf)).select("doc_id", "content_hash")


@query
def chunk_ids(spark, sf):
    hashed = index.with_content_hash(titled(spark, sf))
    return hashed.select("doc_id", tx.chunk_id("doc_id", "content_hash", F.lit(0)).alias("chunk_id"))


@query
def doc_dedup_first(spark, sf):
    firsts = documents(spark, sf).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    return firsts.select("doc_id", "digest")


@query
def doc_duplicates(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tagged = docs.join(first, "digest").withColumn("duplicate_of", F.when(F.col("doc_id") != F.col("first"), F.col("first").cast("string")))
    return tagged.select("doc_id", tx.canonical_id("doc_id", "duplicate_of").alias("canonical"))


@query
def squash_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.squash("text")).alias("digest"), F.length(tx.squash("text")).cast("bigint").alias("chars"))


@query
def embedding_text(spark, sf):
    turns = table(spark, sf, "conversations")
    made = tx.embedding_text(F.concat(F.lit("conversation "), F.col("conv_id")), F.when(F.col("role") == "system", "").otherwise(F.col("role")), "text")
    return turns.select("conv_id", "turn", F.md5(made).alias("digest"))


@query
def capped_sections(spark, sf):
    return sectioned(spark, sf).select("conv_id", F.md5(tx.cap_at_sections("text", 600)).alias("digest"), F.length(tx.cap_at_sections("text", 600)).cast("bigint").alias("chars"))


@query
def without_back_matter(spark, sf):
    text = F.replace("text", F.lit("== assistant =="), F.lit("== References =="))
    return sectioned(spark, sf).select("conv_id", F.md5(tx.strip_back_matter(text)).alias("digest"))


# ------------------------------------------------------------------ ingestion


@query
def ingest_changed_docs(spark, sf):
    docs = index.with_content_hash(titled(spark, sf))
    return index.changed_documents(docs, stored_version(spark, sf)).select("doc_id", "content_hash")


@query
def ingest_counts(spark, sf):
    return index.ingestion_counts(index.with_content_hash(titled(spark, sf)), stored_version(spark, sf))


@query
def replace_document(spark, sf):
    fresh = index.changed_documents(index.with_content_hash(titled(spark, sf)), stored_version(spark, sf)).select("doc_id", "content_hash")
    return index.replace_documents(stored_version(spark, sf), fresh)


def as_chunks(rows: DataFrame, **columns) -> DataFrame:
    """Documents as one chunk each, in the shape that the store keeps; ``columns``: what isn't null or empty."""
    given = {"chunk_id": F.col("doc_id"), "index": F.lit(0), "title": F.lit(""), "text": F.lit(""), "content_hash": F.lit("")} | columns
    return rows.select(*(given.get(f.name, F.col("doc_id") if f.name == "doc_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in index.CHUNK_SCHEMA))


def new_store(spark, dimension: int = 64) -> IndexStore:
    made = IndexStore(spark, stage_path(spark), dimension)
    made.ensure()
    return made


@query
def stored_replace(spark, sf):
    """What an index holds after an earlier version of the corpus was written and the changed documents replaced, its segments merged."""
    old = titled(spark, sf).withColumn("text", tx.squash("text")).select("doc_id", "title", "text")
    gone = items(spark, sf).select(F.concat(F.lit("item:"), F.col("query_id")).alias("doc_id"), F.lit("item").alias("title"), "text")
    store, hashed = new_store(spark), {"title": F.col("title"), "text": F.col("text"), "content_hash": F.col("content_hash")}
    store.replace(as_chunks(index.with_content_hash(old.unionByName(gone)), **hashed))
    docs = index.with_content_hash(titled(spark, sf))
    store.replace(as_chunks(index.changed_documents(docs, store.content_hashes(docs)), **hashed))
    store.compact(fan=2)
    return store.content_hashes()


@query
def posting_blocks(spark, sf):
    """Of each term the postings in all its blocks, and the bounds that hold for them."""
    counted = stage(index.counted_terms(as_chunks(documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), text=F.col("text"))))
    made = index.posting_blocks(index.posting_rows(counted), 100.0)
    return made.groupBy("term").agg(F.sum("n").cast("bigint").alias("n"), F.max("max_tf").cast("bigint").alias("max_tf"), F.min("min_dl").cast("bigint").alias("min_dl"), F.sum(F.size("entries")).alias("entries"))


@query
def bm25_pruned_topk(spark, sf):
    """The lexical top 10 from an index's blocks of postings, of which those that can't matter stay unread."""
    store = new_store(spark)
    store.replace(as_chunks(documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), text=F.col("text")))
    found = search.bm25_topk_stored(items(spark, sf), store, K, prune_from=0)
    return found.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def routed_lists_topk(spark, sf):
    """The nearest vectors in the lists of the clusters that each query is routed to."""
    store = new_store(spark)
    rows = vectors(spark, sf).select(F.col("vec_id").cast("string").alias("doc_id"), "dense", "cluster_id")
    store.replace(as_chunks(rows, dense=F.col("dense"), cluster_id=F.col("cluster_id")))
    routed = search.route(asked(spark, sf), topics(spark, sf), M_ROUTED)
    found = search.dense_topk(asked(spark, sf), store.snapshot().vectors(), K, routed, "chunk_id")
    return found.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query
def paragraphs(spark, sf):
    return chunking.line_spans(documents(spark, sf))


@query
def section_lines(spark, sf):
    found = chunking.sections(sectioned(spark, sf), "conv_id")
    return found.select("conv_id", "line", "section", F.md5("body").alias("digest"))


@query
def chunk_pack(spark, sf):
    return chunking.chunk_documents(titled(spark, sf)).select("doc_id", F.col("index").cast("bigint").alias("index"), "char_start", "char_end", "token_count", "chunk_id", F.md5("text").alias("digest"))


@query
def chunk_sections(spark, sf):
    docs = sectioned(spark, sf).select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("conversation").alias("title"), "text", F.lit("conv.md").alias("source_uri"), F.create_map().cast("map<string,string>").alias("metadata"))
    return chunking.chunk_documents(docs).select("doc_id", F.col("index").cast("bigint").alias("index"), "section", "token_count", F.md5("text").alias("digest"))


@query
def embedding_batches(spark, sf):
    texts = documents(spark, sf).select("doc_id", "source", F.size(tx.tokens("text")).cast("bigint").alias("tokens"))
    return batching.pack_batches(texts, EmbeddingOptions(max_batch_tokens=20_000), group="source")


@query
def request_schedule(spark, sf):
    requests = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.size(tx.tokens("text")).alias("tokens"))
    return batching.schedule(requests, lambda: batching.RateLimiter(requests=300, tokens=20_000, window=60.0)).select("request_id", "tokens", F.round("at", 6).alias("at"))


# ---------------------------------------------------------------------- index


@query
def postings(spark, sf):
    return index.postings(documents(spark, sf))


@query
def doc_freq(spark, sf):
    return index.document_frequencies(index.postings(documents(spark, sf)))


@query
def doc_length(spark, sf):
    return index.document_lengths(documents(spark, sf))


@query
def corpus_statistics(spark, sf):
    return index.corpus_statistics(documents(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_weights(spark, sf):
    docs = documents(spark, sf)
    avgdl = index.corpus_statistics(docs).first().avgdl
    found = index.bm25_weights(index.postings(docs), index.document_lengths(docs), avgdl)
    return found.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def hash_embed(spark, sf):
    made = index.hashed_embedding(documents(spark, sf)).select("doc_id", F.posexplode("dense").alias("i", "x"))
    return made.where("x <> 0").select("doc_id", F.col("i").cast("bigint").alias("i"), F.round("x", 9).alias("x"))


# --------------------------------------------------------------------- search


def _shown(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), id_col, F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, sf):
    return _shown(search.bm25_topk(items(spark, sf), documents(spark, sf), K))


@query
def dense_topk(spark, sf):
    return _shown(search.dense_topk(asked(spark, sf), vectors(spark, sf), K, id_col="vec_id"), "vec_id")


@query
def route_clusters(spark, sf):
    return _shown(search.route(asked(spark, sf), topics(spark, sf), M_ROUTED), "cluster_id")


@query
def dense_topk_filtered(spark, sf):
    routed = search.route(asked(spark, sf), topics(spark, sf), M_ROUTED)
    return _shown(search.dense_topk(asked(spark, sf), vectors(spark, sf), K, routed, "vec_id"), "vec_id")


def _lists(spark, sf, docs: DataFrame | None = None) -> list[DataFrame]:
    return [search.dense_topk(asked(spark, sf), corpus(spark, sf) if docs is None else docs, PREFETCH), search.bm25_topk(items(spark, sf), documents(spark, sf), PREFETCH)]


@query
def hybrid_rrf(spark, sf):
    return search.rrf(_lists(spark, sf), POOL).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 9).alias("score"))


@query
def hybrid_minmax(spark, sf):
    return search.minmax(search.rrf(_lists(spark, sf), POOL)).select("query_id", "doc_id", F.round("relevance", 6).alias("relevance"))


@query
def hybrid_mmr(spark, sf):
    pool = search.rrf(_lists(spark, sf), POOL).join(corpus(spark, sf).select("doc_id", "dense"), "doc_id")
    return _shown(search.mmr(pool, K, WEIGHT))


@query
def dense_mmr(spark, sf):
    own = vectors(spark, sf)
    pool = search.dense_topk(asked(spark, sf), own, POOL, id_col="vec_id").join(own.select("vec_id", "dense"), "vec_id")
    return _shown(search.mmr(pool, K, WEIGHT, "vec_id"), "vec_id")


@query
def retrieve_default(spark, sf):
    sparse = search.bm25_topk(items(spark, sf), documents(spark, sf), PREFETCH)
    return _shown(search.retrieve(asked(spark, sf), corpus(spark, sf), RetrievalOptions(top_k=K), sparse=sparse))


# ----------------------------------------------------------------- clustering


@query
def lloyd_step(spark, sf):
    return topics(spark, sf).select("cluster_id", F.posexplode("centroid").alias("i", "x")).select("cluster_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query
def minibatch_step(spark, sf):
    """One batch (all vectors) moves the first vector of each label, which has met ten before."""
    rows = vectors(spark, sf).select("vec_id", "cluster_id", unit("dense").alias("dense"))
    first = rows.groupBy("cluster_id").agg(F.min_by("dense", "vec_id").alias("c")).orderBy("cluster_id").collect()
    model = clustering.Centres(np.array([r.c for r in first]), np.full(len(first), 10.0))
    clustering.minibatch_step(rows, [model])
    moved = [(r.cluster_id, int(n), i, x) for r, c, n in zip(first, model.centres.tolist(), model.met, strict=True) for i, x in enumerate(c)]
    return spark.createDataFrame(moved, "cluster_id int, met long, i long, x double").withColumn("x", F.round("x", 6))


@query
def normalized_vectors(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(unit("dense")).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query
def assign_clusters(spark, sf):
    return clustering.assign(vectors(spark, sf), topics(spark, sf), "vec_id").select("vec_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query
def cluster_sizes(spark, sf):
    return clustering.cluster_sizes(topics(spark, sf), clustering.assign(vectors(spark, sf), topics(spark, sf), "vec_id"))


@query
def purity(spark, sf):
    near = clustering.assign(vectors(spark, sf), topics(spark, sf), "vec_id").select("vec_id", "cluster_id")
    return clustering.purity(near.join(vectors(spark, sf).select("vec_id", F.col("cluster_id").alias("topic")), "vec_id"))


@query
def silhouette_fixed(spark, sf):
    found = clustering.silhouettes(vectors(spark, sf))
    return found.select("vec_id", "cluster_id", F.round("silhouette", 6).alias("silhouette"))


@query
def kmeans_select_k(spark, sf):
    from ..options import ClusteringOptions

    model = clustering.fit(vectors(spark, sf).drop("cluster_id"), ClusteringOptions(), "vec_id")
    rows = [(k, float(s), k == model.k, model.version) for k, s in sorted(model.silhouette_by_k.items())]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean, version string")


# ----------------------------------------------------------------- evaluation


def _results(spark, sf) -> DataFrame:
    dense, sparse = map(stage, _lists(spark, sf))
    parts = [("dense", dense), ("bm25", sparse), ("hybrid", search.rrf([dense, sparse], K))]
    rows = [d.where(F.col("rank") <= K).select(F.lit(c).alias("config"), "query_id", "rank", "doc_id") for c, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _scores(spark, sf, truth: DataFrame | None = None) -> DataFrame:
    return metrics.score_rankings(_results(spark, sf), stage(relevant(spark, sf)) if truth is None else truth, K)


_METRICS = ("recall_at_5", "recall_at_k", "ndcg_at_k", "mrr_at_k")


@query
def relevant_documents(spark, sf):
    return relevant(spark, sf)


@query
def rank_metrics(spark, sf):
    return _scores(spark, sf).select("config", "query_id", "first_relevant_rank", *[F.round(m, 6).alias(m) for m in _METRICS], "distinct_docs")


@query
def ils(spark, sf):
    found = metrics.intra_list_similarity(_results(spark, sf), corpus(spark, sf), K)
    return found.select("config", "query_id", F.round("ils", 6).alias("ils"))


@query
def metric_summary(spark, sf):
    found = metrics.summarize(_scores(spark, sf))
    return found.select("config", "n_queries", *[F.round(m, 6).alias(m) for m in (*_METRICS, "distinct_docs")])


@query
def summary_by_source(spark, sf):
    """The source of a query is the language of its first relevant document; none where it has no relevant one."""
    truth = stage(relevant(spark, sf))
    lang = truth.join(documents(spark, sf).select("doc_id", "lang"), "doc_id").groupBy("query_id").agg(F.min_by("lang", "doc_id").alias("source"))
    found = metrics.summarize(_scores(spark, sf, truth).join(lang, "query_id"), ("config", "source"), ("ndcg_at_k", "recall_at_k"))
    return found.select("config", "source", "n_queries", F.round("ndcg_at_k", 6).alias("ndcg_at_k"), F.round("recall_at_k", 6).alias("recall_at_k"))


@query
def best_row(spark, sf):
    means = metrics.summarize(_scores(spark, sf)).select("config", F.round("ndcg_at_k", 9).alias("ndcg"))
    return means.join(F.broadcast(means.agg(F.max("ndcg").alias("ndcg"))), "ndcg").select("config", F.round("ndcg", 6).alias("ndcg_at_k"))


@query
def paired_delta(spark, sf):
    return metrics.paired_delta(_scores(spark, sf), "hybrid").select("config", "query_id", F.round("delta", 6).alias("delta"))


@query
def bootstrap_ci(spark, sf):
    found = metrics.bootstrap_ci(_scores(spark, sf), "ndcg_at_k")
    return found.select("config", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query
def median_chars(spark, sf):
    """The exact median that latencies are summarised by, here over text lengths."""
    return metrics.median_latency(documents(spark, sf).select("source", "n_chars"), ("source",), "n_chars").withColumnRenamed("p50_ms", "median_chars")


@query
def topic_counts(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("topics"))


def _diagnosis(spark, sf, docs: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    docs, truth = corpus(spark, sf) if docs is None else docs, relevant(spark, sf) if truth is None else truth
    routed = search.route(asked(spark, sf), topics(spark, sf), M_ROUTED).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cluster_id"))), lambda x: x["cluster_id"]).alias("routed"))
    clusters = truth.join(docs.select("doc_id", "cluster_id"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("relevant_clusters"))
    return routed.join(clusters, "query_id")


@query
def routing_diag(spark, sf):
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _diagnosis(spark, sf).select("query_id", listed("routed"), listed("relevant_clusters"))


@query
def routing_loss(spark, sf):
    docs, truth = stage(corpus(spark, sf)), stage(relevant(spark, sf))
    dense, sparse = map(stage, _lists(spark, sf, docs))
    routes = search.route(asked(spark, sf), topics(spark, sf), 1).select("query_id", "cluster_id")
    near = search.dense_topk(asked(spark, sf), docs, PREFETCH, routes)
    both = [("hybrid", search.rrf([dense, sparse], K)), ("routed", search.rrf([near, sparse], K))]
    rows = both[0][1].withColumn("config", F.lit("hybrid")).unionByName(both[1][1].withColumn("config", F.lit("routed")))
    ndcg = metrics.score_rankings(rows, truth, K).groupBy("query_id").agg(F.max(F.when(F.col("config") == "hybrid", F.col("ndcg_at_k"))).alias("hybrid"), F.max(F.when(F.col("config") == "routed", F.col("ndcg_at_k"))).alias("routed_score"))
    found = metrics.routing_loss(ndcg.join(_diagnosis(spark, sf, docs, truth), "query_id"), 1)
    return found.select("queries", "lost", "outside", "lost_outside", F.round("loss_rate_outside", 6).alias("loss_rate_outside"), F.round("loss_rate_inside", 6).alias("loss_rate_inside"))


@query
def ablation_summary(spark, sf):
    found = ablation.run_configs(asked(spark, sf), stage(corpus(spark, sf, "text")), ablation.ablation_configs(RetrievalOptions(), K), topics(spark, sf))
    scores = metrics.score_rankings(found, stage(relevant(spark, sf)), K)
    return metrics.summarize(scores).select("config", "n_queries", *[F.round(m, 6).alias(m) for m in (*_METRICS, "distinct_docs")])


# ------------------------------------------------------------------ synthesis


@query
def passage_candidates(spark, sf):
    return synthesis.passages(documents(spark, sf)).select("doc_id", "line", F.md5("passage").alias("digest"))


@query
def sample_passages(spark, sf):
    return synthesis.sample_passages(documents(spark, sf)).select("doc_id", "line", F.md5("passage").alias("digest"))


@query
def mirrors(spark, sf):
    made = synthesis.mirrors(titled(spark, sf), per_topic=5, source="src0")
    return made.select("doc_id", F.md5("text").alias("digest"), F.col("metadata")["duplicate_of"].alias("duplicate_of"), F.col("metadata")["topic"].alias("topic"))


@query
def evaluation_set(spark, sf):
    made = evalset.build_eval_set(titled(spark, sf), evalset.first_sentence, per_document=2, pairs_per_topic=5)
    return made.select("query_id", F.md5("query").alias("digest"), F.array_join("relevant_doc_ids", ",").alias("relevant"), "source", "topic")


@query
def multihop_pairs(spark, sf):
    return synthesis.multihop_pairs(documents(spark, sf).select("doc_id", F.col("lang").alias("topic")))
