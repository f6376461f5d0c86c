"""Results as text for a terminal: what was found, and how queries were routed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from textwrap import shorten
from typing import Any


def results(found: dict[str, Any], width: int = 100) -> str:
    """A block for each result of a retrieval, then the clusters and times."""
    out = []
    for place, r in enumerate(found["results"], 1):
        head = r["title"] if not r.get("section") else f"{r['title']}, {r['section']}"
        out += [f"{place:>3}  {r['score']:.4f}  {head}  [{r['source_uri']} {r['char_span'][0]}-{r['char_span'][1]}]", "     " + shorten(r["text"], width)]
    if found.get("routed_clusters"):
        out.append("clusters: " + ", ".join(f"{c['cluster_id']} ({c['similarity']:.3f})" for c in found["routed_clusters"]))
    out.append("ms: " + ", ".join(f"{stage} {ms:.0f}" for stage, ms in found["timings_ms"].items()))
    return "\n".join(out)


def routing(rows: Iterable[dict[str, Any]]) -> str:
    """A line for each query: where it was routed, where its relevant chunks lie, and whether any lies outside."""
    out = []
    for r in rows:
        missed = sorted(set(r["relevant_clusters"]) - set(r["routed"]))
        out.append(f"{r['query_id']}: routed {_list(r['routed'])}; relevant in {_list(r['relevant_clusters'])}" + (f"; missed {_list(missed)}" if missed else ""))
    return "\n".join(out)


def events(stream: Iterable[tuple[str, dict[str, Any]]]) -> str:
    """An answer's events as text with numbered sources."""
    text, cited = [], []
    for kind, data in stream:
        if kind == "text":
            text.append(data["text"])
        elif kind == "citation":
            cited.append(data)
            text.append(f"[{data['source_index'] + 1}] ")
        elif kind == "error":
            text.append(f"({data['title']}: {data['detail']})")
    return "".join(text) + "".join(f"\n[{c['source_index'] + 1}] {c['chunk_id']}" for c in cited)


def _list(values: Sequence[Any]) -> str:
    return ", ".join(map(str, values)) or "none"
