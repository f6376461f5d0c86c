"""Commands: fetch-corpus, ingest, recluster, compact, eval-set, eval, retrieve, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import canonical_id
from .operators import clustering
from .operators.search import bm25_topk_stored
from .options import ChunkingOptions, ClusteringOptions, RetrievalOptions, from_environment
from .plans import ablation, evalset, report, show
from .plans.service import Services, configure_logging, serve
from .sources.corpus import load_documents, load_queries, write_jsonl
from .sources.web import fetch_corpus
from .streaming.ingest import ingest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="harrow")
    parser.add_argument("--index", default="index")
    parser.add_argument("--dimension", type=int, default=64)
    commands = parser.add_subparsers(dest="command", required=True)
    get = commands.add_parser("fetch-corpus", help="articles and papers of the topics in a JSON file: a list of name, category, titles")
    get.add_argument("topics")
    get.add_argument("out")
    get.add_argument("--papers", type=int, default=20, help="of each topic")
    get.add_argument("--max-chars", type=int, default=8000)
    get.add_argument("--mirrors", type=int, default=2, help="near copies for each topic")
    for source in ("articles", "feed"):
        get.add_argument(f"--{source}", type=json.loads, default={}, help=f"options of the {source} source, as JSON")
    commands.add_parser("ingest").add_argument("path")
    commands.add_parser("recluster")
    commands.add_parser("compact", help="merge segments of the index and remove what no version names")
    made = commands.add_parser("eval-set")
    made.add_argument("corpus")
    made.add_argument("out")
    run = commands.add_parser("eval")
    run.add_argument("queries")
    run.add_argument("out")
    run.add_argument("-k", type=int, default=10)
    ask = commands.add_parser("retrieve")
    ask.add_argument("query")
    ask.add_argument("--table", action="store_true", help="lines to read instead of JSON")
    front = commands.add_parser("serve")
    front.add_argument("--host", default="127.0.0.1")
    front.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(argv)

    configure_logging()
    spark = SparkSession.builder.appName("harrow").getOrCreate()
    if a.command == "eval-set":
        rows = evalset.build_eval_set(load_documents(spark, a.corpus), evalset.first_sentence)
        write_jsonl(rows, a.out)
        return 0
    if a.command == "fetch-corpus":
        with open(a.topics, encoding="utf-8") as file:
            topics = json.load(file)
        print(f"wrote {fetch_corpus(spark, topics, a.out, a.papers, a.max_chars, a.mirrors, a.articles, a.feed)} documents to {a.out}")
        return 0
    services = Services.create(spark, a.index, a.dimension)
    if a.command == "ingest":
        done = ingest(services.store, load_documents(spark, a.path), from_environment(ChunkingOptions))
        print(json.dumps(vars(done)))
        return 1 if done.failed else 0
    if a.command == "recluster":
        model = clustering.recluster(services.store, from_environment(ClusteringOptions))
        print(json.dumps({"k": model.k, "silhouette": model.silhouette, "version": model.version, "silhouette_by_k": model.silhouette_by_k}))
    elif a.command == "compact":
        print(json.dumps({"segments_rewritten": services.store.compact(), "folders_removed": services.store.vacuum()}))
    elif a.command == "retrieve":
        found = services.retrieve(a.query, from_environment(RetrievalOptions))
        print(show.results(found) if a.table else json.dumps(found, ensure_ascii=False))
    elif a.command == "serve":
        serve(services, a.host, a.port, from_environment(RetrievalOptions)).serve_forever()
    elif a.command == "eval":
        asked = load_queries(spark, a.queries)
        queries = asked.select("query_id", F.col("query").alias("text"), F.coalesce("source", F.lit("")).alias("source"))
        queries = queries.join(services.embedder.queries(queries, "query_id"), "query_id", "left")
        now = services.store.snapshot()
        stored = now.texts()
        chunks = now.vectors().select(F.col("chunk_id").alias("doc_id"), "dense", "cluster_id")
        canonical = stored.select(F.col("chunk_id").alias("doc_id"), canonical_id("doc_id", F.col("metadata")["duplicate_of"]).alias("canonical"))
        relevant = asked.select("query_id", F.explode("relevant_doc_ids").alias("doc_id"))
        options = from_environment(RetrievalOptions)
        sparse = lambda depth: bm25_topk_stored(queries, now, depth).withColumnRenamed("chunk_id", "doc_id")
        centroids = now.centroids() if now.manifest.model is not None else None
        found = ablation.evaluate(queries, chunks, relevant, a.k, options, centroids, canonical, sparse(max(options.prefetch_limit, options.candidate_pool, a.k)))
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        summary = [r | {c: (r[c]["lo"], r[c]["hi"]) for c in ("ndcg_ci", "delta_ci")} for r in rows(found["summary"])]
        meta = {"k": a.k, "queries": queries.count(), "chunks": now.statistics()[0]}
        topic = stored.select("chunk_id", F.col("metadata")["topic"].alias("topic")).join(now.vectors().select("chunk_id", "cluster_id"), "chunk_id").select("cluster_id", "topic").dropna()
        if not topic.isEmpty():
            meta |= {"topics": topic.select("topic").distinct().count(), "cluster purity": clustering.purity(topic).first()[0]}
        latency = {c.name: ablation.batch_latency(queries, chunks, c, centroids, sparse) for c in ablation.ablation_configs(options, a.k)}
        print(report.write_report(a.out, summary, rows(found["by_source"]), rows(found["scores"]), meta, latency))
    return 0


if __name__ == "__main__":
    sys.exit(main())
