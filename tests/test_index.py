import hashlib
import json
import math
import random
import re
import shutil
import threading
import urllib.error
import urllib.request
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.errors import ClusteringError, EmbeddingError, IndexError_, RateLimitError, SourceError
from harrow.functions import text as tx
from harrow.functions.text import embedding_text
from harrow.operators import batching as B
from harrow.operators import clustering as L
from harrow.operators import index
from harrow.operators import metrics as M
from harrow.operators import search as R
from harrow.operators import synthesis as Y
from harrow.operators.index import CHUNK_SCHEMA
from harrow.operators.store import IndexStore
from harrow.options import ClusteringOptions, EmbeddingOptions
from harrow.plans.answer import Complete, Extractive, Text, answer_events
from harrow.plans import show
from harrow.plans.report import BEGIN, END, markdown, summary_table, update_section
from harrow.plans.service import Services, request_options, serve
from harrow.options import RetrievalOptions
from harrow.sources import corpus as S
from harrow.streaming.ingest import HashedEmbedder, ingest, ingest_stream, latest_changes

DOCS = "doc_id string, title string, text string, source_uri string, metadata map<string,string>"


def test_ids_and_hashes(spark):
    row = spark.range(1).select(tx.content_hash(F.lit("t"), F.lit("é\nx")).alias("h"), tx.chunk_id(F.lit("dé"), F.lit("h"), F.lit(3)).alias("c"), tx.squash(F.lit(" a\t  b \n")).alias("s")).first()
    assert row.h == hashlib.sha256("t\né\nx".encode()).hexdigest() and row.c == str(uuid.uuid5(tx.CHUNK_NAMESPACE, "dé:h:3")) and row.s == "a b"


def test_sections_are_capped_whole(spark):
    text = "Lead.\n== A ==\naaaa\n=== B ===\nbb\n== C ==\ncccc\n== References ==\nr"
    row = lambda n: spark.range(1).select(tx.cap_at_sections(tx.strip_back_matter(F.lit(text)), n).alias("t")).first().t
    assert row(1) == "Lead." and row(35) == "Lead.\n== A ==\naaaa\n=== B ===\nbb" and row(1000).endswith("cccc")


def test_jsonl_and_folders(spark, tmp_path):
    good = tmp_path / "docs.jsonl"
    good.write_text('{"doc_id": 1, "title": "t", "text": "x", "source_uri": "u", "metadata": {"a": 1}}\n\n{"doc_id": "2", "title": "t", "text": "y", "source_uri": "u"}\n')
    rows = {r.doc_id: r for r in S.load_documents(spark, str(good)).collect()}
    assert rows["1"].metadata == {"a": "1"} and rows["2"].metadata == {}
    for wrong in ('{"doc_id": 1, "title": "t", "text": "x"}', "not json", '{"doc_id": 1, "title": "t", "text": "x", "source_uri": "u", "metadata": 3}'):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(wrong + "\n")
        with pytest.raises(Exception, match="malformed record"):
            S.load_documents(spark, str(bad)).collect()
    folder = tmp_path / "folder"
    (folder / "sub dir").mkdir(parents=True)
    (folder / "a.md").write_text("intro\n# The Title\ntext")
    (folder / "sub dir" / "plain.txt").write_text("no heading")
    (folder / "c.bin").write_text("no")
    rows = {r.doc_id: r.title for r in S.load_documents(spark, str(folder)).collect()}
    assert rows == {"file:a.md": "The Title", "file:sub dir/plain.txt": "plain"}
    with pytest.raises(SourceError):
        S.load_documents(spark, str(tmp_path / "nowhere"))


def _docs(spark, **texts):
    return spark.createDataFrame([(k, f"title {k}", v, f"{k}.txt", {"source": "s"}) for k, v in texts.items()], DOCS)


def test_incremental_ingest(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 16)
    first = ingest(store, _docs(spark, a="one two three", b="four five", c="six"))
    assert (first.seen, first.unchanged, first.indexed, first.chunks, first.failures) == (3, 0, 3, 3, {})
    again = ingest(store, _docs(spark, a="one two three", b="four five changed", c=""))
    assert (again.seen, again.unchanged, again.indexed, again.failures) == (3, 1, 1, {"c": "no text to index"})
    kept = {r.doc_id: r.text for r in store.read("chunks").collect()}
    assert kept == {"a": "one two three", "b": "four five changed", "c": "six"}
    assert ingest(store, _docs(spark, b="four five changed")).indexed == 0 and store.count_chunks() == 3
    other = IndexStore(spark, str(tmp_path / "index"), 8)
    with pytest.raises(IndexError_, match="another length"):
        other.ensure()


def test_titles_are_searched_and_postings_follow_the_chunks(spark, tmp_path):
    services = Services.create(spark, str(tmp_path / "index"), 16)
    ingest(services.store, _docs(spark, zebra="one two three", b="four five", c="two two"))
    ask = lambda q: [r["doc_id"] for r in services.retrieve(q, RetrievalOptions(top_k=3, use_dense=False, mmr_lambda=None))["results"]]
    assert ask("zebra") == ["zebra"] and ask("two") == ["c", "zebra"] and ask("nothing") == []
    ingest(services.store, _docs(spark, b="four two"))
    assert ask("five") == [] and set(ask("two")) == {"b", "c", "zebra"}
    text = services.store.read("chunks").select(F.col("chunk_id").alias("doc_id"), embedding_text("title", "section", "text").alias("text"))
    asked = spark.createDataFrame([(0, "two title zebra"), (1, "four")], "query_id int, text string")
    direct = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in R.bm25_topk(asked, text, 5).collect()}
    stored = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in R.bm25_topk_stored(asked, services.store, 5).collect()}
    assert direct == stored and len(direct) > 3
    found = services.retrieve("two")
    assert set(found["timings_ms"]) == {"embed", "sparse", "dense", "rank", "total"} and services.store.ping()
    shutil.rmtree(tmp_path / "index" / "postings")
    with pytest.raises(IndexError_):
        services.store.ping()


class FailsOn:
    """An embedder that a group of documents breaks."""

    def __init__(self, word):
        self.word = word

    def documents(self, texts, id_col):
        if texts.where(F.col("text").contains(self.word)).count():
            raise EmbeddingError("no vector")
        return HashedEmbedder(16).documents(texts, id_col)

    queries = documents


def test_a_group_that_fails_leaves_the_others(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 16)
    docs = _docs(spark, **{f"d{i}": f"text number {i}" + (" poison" if i == 3 else "") for i in range(20)})
    report = ingest(store, docs, embed=FailsOn("poison"), flush_documents=4)
    assert "d3" in report.failures and 0 < len(report.failures) < 20 and report.indexed == 20 - len(report.failures) == store.count_chunks()
    again = ingest(store, docs, flush_documents=4)
    assert again.unchanged == report.indexed and again.indexed == len(report.failures) and store.count_chunks() == 20


def test_of_a_repeated_id_the_largest_hash_counts(spark):
    rows = spark.createDataFrame([("a", "h1", "x"), ("a", "h2", "y"), ("b", "h3", "z"), ("b", "h3", "z"), ("c", "h4", "w")], "doc_id string, content_hash string, text string")
    held = spark.createDataFrame([("c", "h4"), ("a", "h1")], "doc_id string, content_hash string")
    keys, changed = latest_changes(rows, held)
    assert keys.count() == 3 and sorted((r.doc_id, r.text) for r in changed.collect()) == [("a", "y"), ("b", "z")]


def test_service_over_an_index(spark, tmp_path):
    services = Services.create(spark, str(tmp_path / "index"), 16)
    texts = {f"d{i}": " ".join(random.Random(i).choices("sun moon star sky night day".split(), k=20)) for i in range(12)}
    ingest(services.store, _docs(spark, **texts))
    model = L.recluster(services.store, ClusteringOptions(n_clusters=2))
    assert model.version.startswith("k2-") and services.store.read("chunks").where("cluster_id is null").count() == 0
    assert services.store.read("centroids").agg(F.sum("size")).first()[0] == 12
    found = services.retrieve("moon night", RetrievalOptions(top_k=3, route_top_m=1))
    assert len(found["results"]) == 3 and len(found["routed_clusters"]) == 1
    events = list(services.answer("moon night", RetrievalOptions(top_k=3)))
    assert events[0].startswith("event: sources") and events[-1].startswith("event: done") and sum(e.startswith("event: done") for e in events) == 1
    query, options = request_options({"query": "x", "top_k": 50, "mmr_lambda": None}, RetrievalOptions())
    assert options.candidate_pool == 50 and options.mmr_lambda == 0.7
    with pytest.raises(ValueError):
        request_options({"query": ""}, RetrievalOptions())


def test_http_front(spark, tmp_path):
    services = Services.create(spark, str(tmp_path / "index"), 16)
    ingest(services.store, _docs(spark, a="sun and moon", b="stars at night"))
    server = serve(services, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None, **headers):
        request = urllib.request.Request(base + path, None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, answer.headers, answer.read().decode()
        except urllib.error.HTTPError as wrong:
            return wrong.code, wrong.headers, wrong.read().decode()

    try:
        assert call("/healthz")[0] == call("/readyz")[0] == 200 and call("/nowhere")[0] == 404
        status, headers, body = call("/v1/retrieve", {"query": "moon", "top_k": 1}, **{"x-request-id": "r1"})
        assert status == 200 and headers["x-request-id"] == "r1" and json.loads(body)["results"][0]["doc_id"] == "a"
        status, headers, body = call("/v1/retrieve", {"query": "", "top_k": 1})
        assert status == 422 and headers["content-type"] == "application/problem+json"
        status, _, body = call("/v1/answer", {"query": "moon"})
        assert status == 200 and body.startswith("event: sources") and "event: done" in body
    finally:
        server.shutdown()


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"doc_id": "1", "title": "t", "text": "x y", "source_uri": "u"}\n')
    store, reports = IndexStore(spark, str(tmp_path / "index"), 16), []
    store.ensure()
    for _ in range(2):
        ingest_stream(spark, store, str(folder), str(tmp_path / "ck"), reports.append).awaitTermination()
        (folder / "2.jsonl").write_text('{"doc_id": "2", "title": "t", "text": "z", "source_uri": "u"}\n')
    assert [r.indexed for r in reports] == [1, 1] and store.count_chunks() == 2 and store.read("chunks").columns == CHUNK_SCHEMA.fieldNames()


def test_mini_batches_come_near_whole_passes(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    rows = spark.read.parquet(path).selectExpr("vec_id", "embedding dense", "label")
    found = {}
    for method in ("minibatch", "lloyd"):
        model = L.fit(rows, ClusteringOptions(n_clusters=10, method=method, batch_rows=100), "vec_id")
        near = L.with_nearest(rows, L.centroid_table(model, spark)).withColumn("topic", F.col("label"))
        found[method] = L.purity(near).first().purity, model.silhouette, model.version
    assert found["minibatch"][0] > found["lloyd"][0] - 0.03 and found["minibatch"][1] > found["lloyd"][1] - 0.02
    assert L.fit(rows.repartition(7), ClusteringOptions(n_clusters=10, batch_rows=100), "vec_id").version == found["minibatch"][2]


def test_a_batch_moves_centres_by_what_they_have_met(spark):
    rng = np.random.default_rng(3)
    batch, centres, met = rng.normal(size=(40, 5)), rng.normal(size=(4, 5)) * 3, np.array([0.0, 5.0, 50.0, 0.0])
    centres[3] = 100  # meets nothing
    model = L.Centres(centres.copy(), met.copy())
    cost = L.minibatch_step(spark.createDataFrame([(x.tolist(),) for x in batch], "dense array<double>").repartition(3), [model, L.Centres(centres[:2].copy(), met[:2])])
    wanted, seen, total = centres.copy(), met.copy(), 0.0
    nearest = [int(np.argmin(((x - centres) ** 2).sum(axis=1))) for x in batch]
    for x, c in zip(batch, nearest, strict=True):
        seen[c] += 1
        wanted[c] += (x - wanted[c]) / seen[c]  # one vector after the other
        total += float(((x - centres[c]) ** 2).sum())
    assert np.allclose(model.centres, wanted) and model.met.tolist() == seen.tolist() and abs(cost[0] - total) < 1e-6 and len(cost) == 2


def test_silhouettes_of_many_models_take_two_passes(spark):
    rng = np.random.default_rng(5)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit(rng.normal(size=(60, 5))))] + [(60, [0.0] * 5)], "vec_id int, dense array<double>").repartition(3)
    models = [unit(rng.normal(size=(k, 5))) for k in (2, 3, 7, 30)]  # of 30 some are met by one row or none
    models += [np.array([[1.0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0]])]  # ties go to the first: one cluster in use
    spark.sparkContext.setJobGroup("silhouettes", "")
    found = L.nearest_silhouettes(rows, models)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("silhouettes"))
    spark.sparkContext.setJobGroup("others", "")
    tables = [spark.createDataFrame([(i, c) for i, c in enumerate(m.tolist())], "cluster_id int, centroid array<double>") for m in models]
    assert np.allclose(found, [L.mean_silhouette(L.with_nearest(rows, t), "vec_id") for t in tables], atol=1e-12) and found[-1] == -1
    assert jobs <= 6  # with adaptive execution a stage is a job


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{c}-{i}", (np.eye(8)[c] + rng.normal(0, 0.05, 8)).tolist()) for c in range(4) for i in range(25)]
    vectors = spark.createDataFrame(rows, "chunk_id string, dense array<double>")
    model = L.fit(vectors, ClusteringOptions(k_grid=(2, 4)))
    assert model.k == 4 and model.silhouette > 0.8 and all(abs(np.linalg.norm(c) - 1) < 1e-9 for c in model.centroids)
    near = L.assign(vectors, L.centroid_table(model, spark)).withColumn("topic", F.substring("chunk_id", 1, 1))
    assert L.purity(near).first().purity == 1.0
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    labels = np.repeat(np.arange(4), 25)
    got = {r.vec_id: r.silhouette for r in L.silhouettes(spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(u, labels, strict=True))], "vec_id int, dense array<double>, cluster_id int")).collect()}
    far = 1 - u @ u.T
    for i in range(0, 100, 7):
        own = (labels == labels[i]) & (np.arange(100) != i)
        a, b = far[i, own].mean(), min(far[i, labels == c].mean() for c in range(4) if c != labels[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
    with pytest.raises(ClusteringError):
        L.fit(vectors.limit(2), ClusteringOptions(n_clusters=4))


def test_limiter_and_batches():
    pace, now, sent = B.RateLimiter(requests=3, window=60.0), 0.0, []
    for _ in range(4):
        now += pace.wait(1, now)
        sent.append(now)
    assert sent == [0, 20, 40, 60]
    tokens = B.RateLimiter(tokens=100, window=60.0)
    assert [tokens.wait(60, 0.0), tokens.wait(60, 0.0)] == [0.0, 60.0]
    with pytest.raises(RateLimitError):
        tokens.wait(101, 0.0)
    assert B.greedy_batches([5, 5, 5, 100, 1], 2, 10) == [0, 0, 1, 2, 3]
    calls = []
    with pytest.raises(OSError):
        B.with_retries(lambda: calls.append(1) or (_ for _ in ()).throw(OSError()), (OSError,), 2, lambda s: None, lambda: 1.0)
    assert len(calls) == 3


def test_batches_per_group(spark):
    rows = spark.createDataFrame([(i, i % 2, 4) for i in range(10)], "doc_id int, g int, tokens bigint")
    out = B.pack_batches(rows, EmbeddingOptions(max_batch_texts=2), group="g").collect()
    assert sorted((r.g, r.doc_id, r.batch) for r in out) == [(g, i, (i // 2) // 2) for g in (0, 1) for i in range(g, 10, 2)]
    assert B.pack_batches(rows, EmbeddingOptions(max_batch_tokens=8)).agg(F.max("batch")).first()[0] == 4


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_batches_over_ranges_are_those_of_one_walk(spark, parts):
    rng = random.Random(int(parts))
    rows = [(i, rng.choice("aaaabc"), rng.choice([1, 1, 2, 3, 9, 30])) for i in range(700)] + [(1000 + i, None, 5) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id int, g string, tokens bigint")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for options in (EmbeddingOptions(max_batch_texts=7, max_batch_tokens=20), EmbeddingOptions(max_batch_texts=100, max_batch_tokens=25), EmbeddingOptions(max_batch_texts=100, max_batch_tokens=100_000)):
            wanted = {}
            for g in [None, *"abc"]:
                own = [(i, n) for i, x, n in rows if x == g]
                wanted.update({i: (g, n, b) for (i, n), b in zip(own, B.greedy_batches([n for _, n in own], options.max_batch_texts, options.batch_tokens), strict=True)})
            assert {r.doc_id: (r.g, r.tokens, r.batch) for r in B.pack_batches(df, options, group="g").collect()} == wanted
            whole = B.greedy_batches([n for _, _, n in rows], options.max_batch_texts, options.batch_tokens)
            assert [r.batch for r in B.pack_batches(df, options).orderBy("doc_id").collect()] == whole
        assert B.pack_batches(df.where("false"), EmbeddingOptions()).count() == 0
        with pytest.raises(RateLimitError):
            B.pack_batches(df, EmbeddingOptions(tokens_per_minute=20))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("block", "values"), [(1 << 16, 1 << 22), (7, 1 << 22), (7, 20)])
def test_intervals_are_those_of_the_draws_one_by_one(spark, monkeypatch, block, values):
    rng = np.random.default_rng(4)
    rows = [(c, f"q{i:02}", float(rng.random())) for c in "ab" for i in range(23) if (c, i) != ("b", 5)] + [("a", "null", None)]
    monkeypatch.setattr(M, "MATRIX_VALUES", values)
    monkeypatch.setattr(M.resamples, "__defaults__", (M.RESAMPLES, block))
    monkeypatch.setattr(M, "BLOCK_PLACES", block)
    got = {r.config: (r.mean, r.lo, r.hi) for r in M.bootstrap_ci(spark.createDataFrame(rows, "config string, query_id string, v double"), "v", count=150).collect()}
    drawn = [[int(hashlib.md5(f"{d}:{p}".encode()).hexdigest()[:8], 16) % 23 for p in range(23)] for d in range(150)]
    for c in "ab":
        own = {int(q[1:]): v for g, q, v in rows if g == c and v is not None}
        means = [np.mean([own[i] for i in places if i in own]) for places in drawn]
        assert np.allclose(got[c], (np.mean(list(own.values())), *np.percentile(means, [2.5, 97.5])))
    assert M.bootstrap_ci(spark.createDataFrame([], "config string, query_id string, v double"), "v").count() == 0


def test_mirrors_keep_lead_and_headings(spark):
    text = "lead\n\n== H ==\n" + "\n".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([("a", "t", text, "u", {"source": "wikipedia", "topic": "x"}), ("b", "t", text, "u", {"source": "arxiv", "topic": "x"})], DOCS)
    rows = Y.mirrors(docs).collect()
    lines = rows[0].text.split("\n")
    assert len(rows) == 1 and rows[0].doc_id == "mirror:a" and lines[:3] == ["lead", "", "== H =="] and 20 < len(lines) < 43
    assert rows[0].metadata == {"source": "mirror", "topic": "x", "duplicate_of": "a"} and rows == Y.mirrors(docs).collect()


def test_pairs_are_distinct_and_within_a_topic(spark):
    docs = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(90)] + [(100, "w"), (200, "v"), (201, "v")], "doc_id int, topic string")
    pairs = Y.multihop_pairs(docs, per_topic=5).collect()
    topic = {r.doc_id: r.topic for r in docs.collect()}
    assert all(topic[p.first] == topic[p.second] == p.topic and p.first < p.second for p in pairs)
    assert len(set(pairs)) == len(pairs) == 16 and sorted(pairs) == sorted(Y.multihop_pairs(docs, per_topic=5).collect())


def test_answers_and_reports(tmp_path):
    class Odd:
        def stream(self, question, sources):
            yield Text("a")

    assert list(answer_events("q", [], Odd()))[-1].startswith("event: error")
    done = list(Extractive().stream("what", []))
    assert isinstance(done[-1], Complete) and done[-1].refused
    row = {"config": "a", "ndcg_at_k": 0.5, "ndcg_ci": (0.4, 0.6), "delta": 0.0, "delta_ci": (0, 0), "recall_at_5": None, "recall_at_k": 1.0, "mrr_at_k": 0.25, "distinct_docs": 7.0, "ils": 0.5}
    other = row | {"config": "b", "ndcg_at_k": 0.4, "delta": -0.1, "delta_ci": (-0.2, 0.0)}
    lines = summary_table([row, other], 10).split("\n")
    assert "0.500 (0.400 to 0.600) *" in lines[2] and "baseline" in lines[2] and "-0.100 (-0.200 to +0.000)" in lines[3]
    whole = markdown([row, other], [{"config": "a", "source": "s", "ndcg_at_k": 0.1, "recall_at_k": None}], {"k": 10, "cluster purity": 0.8}, {"a": 3.0})
    assert "- cluster purity: 0.8" in whole and "0.100, " in whole and "## Diversity" in whole and "| a " in whole
    found = {"results": [{"title": "t", "section": "s", "score": 0.5, "source_uri": "u", "char_span": [0, 4], "text": "a b"}], "routed_clusters": [{"cluster_id": 1, "similarity": 0.25}], "timings_ms": {"total": 3.0}}
    assert "t, s" in show.results(found) and "1 (0.250)" in show.results(found)
    assert show.routing([{"query_id": 1, "routed": [2], "relevant_clusters": [2, 3]}]) == "1: routed 2; relevant in 2, 3; missed 3"
    assert show.events([("text", {"text": "x "}), ("citation", {"source_index": 0, "chunk_id": "c"}), ("done", {})]) == "x [1] \n[1] c"
    page = tmp_path / "r.md"
    page.write_text(f"x {BEGIN} old {END} y")
    assert update_section(str(page), "new") and page.read_text() == f"x {BEGIN}\nnew\n{END} y"
    page.write_text("none")
    assert not update_section(str(page), "new")


def test_hashed_vectors_row_by_row(spark, monkeypatch):
    rows = [(1, "Red red, green; blue"), (2, None), (3, ""), (4, "..."), (5, "word " * 30_000), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dense", F.lit(0))
    for dimension in (64, 100):
        wanted = []
        for i, text in rows:
            sums = [0] * dimension
            for term in re.findall("[a-z0-9]+", (text or "").lower()):
                h = hashlib.md5(term.encode()).hexdigest()
                sums[int(h[:8], 16) % dimension] += 1 - 2 * (int(h[8:10], 16) % 2)
            norm = math.sqrt(sum(x * x for x in sums))
            if norm:
                wanted.append((i, [x / norm for x in sums]))
        got = [(r.doc_id, r.dense) for r in index.hashed_embedding(docs, dimension=dimension).collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)
    assert index.hashed_embedding(docs.where("false")).count() == 0


def test_embedding_holds_the_terms_of_a_slice_and_keeps_columns(spark, monkeypatch):
    monkeypatch.setattr(index, "ROWS_AT_ONCE", 2)
    docs = spark.createDataFrame([(i, f"moon sun{i} moon" if i != 3 else None, f"k{i}") for i in range(7)], "doc_id int, text string, kept string").coalesce(1)
    made = index.hashed_embedding(docs, dimension=8, keep=("kept",))
    rows = [(r.doc_id, r.kept, r.dense) for r in made.collect()]
    assert [r[:2] for r in rows] == [(i, f"k{i}") for i in range(7) if i != 3]
    batch = docs.select(F.split("text", " ").alias("t"), "doc_id", "kept").where("text is not null").toArrow().combine_chunks().to_batches()[0]
    out = list(index._feature_hashes(iter([batch]), 8))
    assert [b.num_rows for b in out] == [2, 2, 2] and [x for b in out for x in b.column(2).to_pylist()] == [r[2] for r in rows]
