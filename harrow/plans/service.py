"""Retrieval over a stored index: a Python call, and a small HTTP front for it."""

from __future__ import annotations

import json
import logging
import time
import uuid
from dataclasses import dataclass, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError, HarrowError
from ..operators.store import IndexStore
from ..operators.search import bm25_topk_stored, dense_topk, retrieve, route
from ..options import RetrievalOptions
from ..streaming.ingest import Embedder, HashedEmbedder
from .answer import Answerer, Extractive, answer_events, problem

log = logging.getLogger("harrow")


def configure_logging(level: str = "INFO", as_json: bool = True) -> None:
    class Json(logging.Formatter):
        def format(self, record: logging.LogRecord) -> str:
            return json.dumps({"time": self.formatTime(record), "level": record.levelname, "event": record.getMessage(), "logger": record.name})

    handler = logging.StreamHandler()
    handler.setFormatter(Json() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(level)


def request_options(body: dict[str, Any], defaults: RetrievalOptions) -> tuple[str, RetrievalOptions]:
    """The query and options of a request; out-of-range values are refused."""
    query = body.get("query")
    if not isinstance(query, str) or not 1 <= len(query) <= 2000:
        raise ConfigurationError("query must be 1 to 2000 characters")
    limits = {"top_k": (1, 50), "mmr_lambda": (0, 1), "route_top_m": (0, 64)}
    for name, (low, high) in limits.items():
        if body.get(name) is not None and not low <= body[name] <= high:
            raise ConfigurationError(f"{name} must lie in [{low}, {high}]")
    return query, defaults.with_overrides(**{n: body.get(n) for n in limits})


@dataclass
class Services:
    """Session, index and generator together."""

    spark: SparkSession
    store: IndexStore
    generator: Answerer
    embedder: Embedder

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int = 64, generator: Answerer | None = None, embedder: Embedder | None = None) -> Services:
        store = IndexStore(spark, path, dimension)
        store.ensure()
        return cls(spark, store, generator or Extractive(), embedder or HashedEmbedder(dimension))

    def retrieve(self, query: str, options: RetrievalOptions | None = None) -> dict[str, Any]:
        """results, routed_clusters and timings of one query."""
        options, begun = options or RetrievalOptions(), time.monotonic()
        timings: dict[str, float] = {}

        def timed(stage: str, made: DataFrame) -> DataFrame:
            """The rows of a stage, small enough for one query to be held here."""
            at = time.monotonic()
            rows = made.collect()
            timings[stage] = round(1000 * (time.monotonic() - at), 2)
            return self.spark.createDataFrame(rows, made.schema)

        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        queries = timed("embed", asked.join(self.embedder.queries(asked, "query_id"), "query_id", "left"))
        now = self.store.snapshot()
        vectors = now.vectors().select("chunk_id", "dense", "cluster_id")
        centroids = now.centroids() if now.manifest.model is not None else None
        if options.route_top_m and centroids is None:
            log.warning("routing asked for, but there is no cluster model; searching all clusters")
        routed = None
        if options.route_top_m and centroids is not None and options.use_dense:
            routed = timed("route", route(queries, centroids, options.route_top_m))
        depth = options.prefetch_limit if options.use_dense and options.use_sparse else options.limit
        sparse = timed("sparse", bm25_topk_stored(queries, now, depth)) if options.use_sparse else None
        dense = timed("dense", dense_topk(queries, vectors, depth, routed.select("query_id", "cluster_id") if routed is not None else None, "chunk_id")) if options.use_dense else None
        found = retrieve(queries, vectors, replace(options, route_top_m=0), None, id_col="chunk_id", sparse=sparse, dense=dense)
        columns = ("chunk_id", "doc_id", "title", "section", "text", "source_uri", "char_start", "char_end")
        rows = timed("rank", found.join(now.texts().select(*columns), "chunk_id").orderBy("rank")).orderBy("rank").collect()
        timings["total"] = round(1000 * (time.monotonic() - begun), 2)
        results = [{c: r[c] for c in columns[:-2]} | {"char_span": [r.char_start, r.char_end], "score": r.score} for r in rows]
        clusters = [] if routed is None else [{"cluster_id": r.cluster_id, "similarity": r.score} for r in routed.orderBy("rank").collect()]
        return {"results": results, "routed_clusters": clusters, "timings_ms": timings}

    def answer(self, query: str, options: RetrievalOptions | None = None):
        """Events of an answer; retrieval happens first, so its errors aren't part of the stream."""
        sources = self.retrieve(query, options)["results"]
        return answer_events(query, sources, self.generator)


def handler(services: Services, defaults: RetrievalOptions) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict[str, Any], kind: str = "application/json") -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("content-type", kind)
            self.send_header("x-request-id", self.request_id)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _run(self, call) -> None:
            self.request_id = self.headers.get("x-request-id") or uuid.uuid4().hex
            try:
                call()
            except ConfigurationError as wrong:
                self._send(422, problem(wrong) | {"status": 422}, "application/problem+json")
            except HarrowError as failed:
                self._send(problem(failed)["status"], problem(failed), "application/problem+json")

        def do_GET(self) -> None:
            def call():
                if self.path == "/readyz":
                    services.store.ping()
                self._send(200 if self.path in ("/healthz", "/readyz") else 404, {"status": "ok" if self.path in ("/healthz", "/readyz") else "not found"})

            self._run(call)

        def do_POST(self) -> None:
            def call():
                body = json.loads(self.rfile.read(int(self.headers.get("content-length") or 0)) or b"{}")
                query, options = request_options(body, defaults)
                if self.path == "/v1/retrieve":
                    self._send(200, {"request_id": self.request_id, **services.retrieve(query, options)})
                elif self.path == "/v1/answer":
                    events = services.answer(query, options)
                    self.send_response(200)
                    self.send_header("content-type", "text/event-stream")
                    self.send_header("x-request-id", self.request_id)
                    self.end_headers()
                    for e in events:
                        self.wfile.write(e.encode())
                else:
                    self._send(404, {"status": "not found"})

            self._run(call)

        def log_message(self, format: str, *args) -> None:
            log.info(format, *args)

    return Handler


def serve(services: Services, host: str = "127.0.0.1", port: int = 8000, defaults: RetrievalOptions | None = None) -> ThreadingHTTPServer:
    """A server that isn't running yet; call ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(services, defaults or RetrievalOptions()))
