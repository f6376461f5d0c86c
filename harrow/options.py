"""Options of chunking, indexing, search and clustering; their defaults are part of the semantics."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from .errors import ConfigurationError


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigurationError(message)


@dataclass(frozen=True)
class ChunkingOptions:
    max_tokens: int = 512
    overlap_tokens: int = 64

    def __post_init__(self):
        _need(self.max_tokens >= 32, "max_tokens must be 32 or more")
        _need(0 <= self.overlap_tokens < self.max_tokens, "overlap_tokens must be at least 0 and below max_tokens")


@dataclass(frozen=True)
class EmbeddingOptions:
    dimension: int = 1024
    max_batch_texts: int = 128
    max_batch_tokens: int = 100_000
    requests_per_minute: int | None = None
    tokens_per_minute: int | None = None
    max_retries: int = 6

    def __post_init__(self):
        _need(1 <= self.max_batch_texts <= 1000, "max_batch_texts must be 1 to 1000")
        _need(self.max_batch_tokens >= 1, "max_batch_tokens must be positive")

    @property
    def batch_tokens(self) -> int:
        return min(self.max_batch_tokens, self.tokens_per_minute or self.max_batch_tokens)


@dataclass(frozen=True)
class Bm25Options:
    """k1 and b of BM25; queries weigh each distinct term once."""

    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class ClusteringOptions:
    n_clusters: int | None = None
    k_grid: tuple[int, ...] = (4, 6, 8, 10, 12, 16)
    silhouette_sample_size: int = 5000
    random_state: int = 42
    method: str = "minibatch"
    n_init: int = 5
    batch_rows: int = 1024
    max_passes: int = 10
    tolerance: float = 1e-3

    def __post_init__(self):
        _need(self.method in ("minibatch", "lloyd"), "method must be minibatch or lloyd")
        _need(self.n_init >= 1 and self.batch_rows >= 1 and self.max_passes >= 1, "n_init, batch_rows and max_passes must be positive")
        _need(self.n_clusters is None or self.n_clusters >= 2, "n_clusters must be 2 or more")
        _need(self.silhouette_sample_size >= 100, "silhouette_sample_size must be 100 or more")


@dataclass(frozen=True)
class RetrievalOptions:
    """Which stages run, and their sizes. ``mmr_lambda`` None turns re-ranking off."""

    use_dense: bool = True
    use_sparse: bool = True
    top_k: int = 8
    candidate_pool: int = 40
    prefetch_limit: int = 100
    mmr_lambda: float | None = 0.7
    route_top_m: int = 0
    rrf_k: int = 60

    def __post_init__(self):
        _need(self.use_dense or self.use_sparse, "at least one of the dense and sparse branches must be on")
        _need(self.mmr_lambda is None or 0 <= self.mmr_lambda <= 1, "mmr_lambda must lie in [0, 1]")
        _need(1 <= self.top_k <= self.candidate_pool, "top_k must be at least 1 and at most candidate_pool")
        _need(self.route_top_m >= 0 and self.prefetch_limit >= 1, "route_top_m and prefetch_limit must not be negative")

    @property
    def limit(self) -> int:
        """Rows that fusion hands on: the pool if it is re-ranked, else the result."""
        return self.top_k if self.mmr_lambda is None else self.candidate_pool

    def with_overrides(self, **changes) -> RetrievalOptions:
        """Replace what isn't None; a pool below a raised top_k is raised with it."""
        given = {k: v for k, v in changes.items() if v is not None}
        if "candidate_pool" not in given:
            given["candidate_pool"] = max(self.candidate_pool, given.get("top_k", self.top_k))
        return replace(self, **given)


def from_environment(kind: type, prefix: str = "HARROW", environ: dict[str, str] | None = None):
    """An options object from its defaults and ``PREFIX__FIELD`` variables."""
    environ = os.environ if environ is None else environ
    own = {}
    for f in fields(kind):
        raw = environ.get(f"{prefix}__{f.name.upper()}")
        if raw is None:
            continue
        if raw.lower() in ("none", ""):
            own[f.name] = None
        elif isinstance(f.default, bool):
            own[f.name] = raw.lower() in ("1", "true", "yes", "on")
        elif isinstance(f.default, str):
            own[f.name] = raw
        elif isinstance(f.default, tuple):
            own[f.name] = tuple(int(x) for x in raw.split(","))
        elif isinstance(f.default, float) or f.name == "mmr_lambda":
            own[f.name] = float(raw)
        else:
            own[f.name] = int(raw)
    return kind(**own)
