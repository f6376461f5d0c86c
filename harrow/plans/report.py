"""The evaluation report: JSON, Markdown, a section of the README. Inputs are small summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

BEGIN, END = "<!-- evaluation:begin -->", "<!-- evaluation:end -->"


#: How a cell shows a number: decimals, and whether its sign is always written.
Style = tuple[int, bool]
MEAN, SHIFT, COUNT = (3, False), (3, True), (1, False)


def shown(value: float | None, style: Style = MEAN) -> str:
    """A number in its style; nothing for an unknown one."""
    digits, signed = style
    return "" if value is None else format(value, f"{'+' if signed else ''}.{digits}f")


def ranged(value: float | None, ends: Sequence[float], style: Style = MEAN) -> str:
    """A number and the two ends of its interval."""
    return f"{shown(value, style)} ({shown(ends[0], style)} to {shown(ends[1], style)})"


def table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """A Markdown table, columns as wide as their longest cell."""
    wide = [max(3, *(len(str(row[i])) for row in [head, *rows])) for i in range(len(head))]
    line = lambda cells: "| " + " | ".join(str(c).ljust(w) for c, w in zip(cells, wide, strict=True)) + " |"
    return "\n".join([line(head), line(["-" * w for w in wide]), *map(line, rows)])


def summary_table(rows: Sequence[dict[str, Any]], k: int) -> str:
    """A line for each configuration, the best first column marked; a baseline has no shift from itself."""
    ahead = max((r["ndcg_at_k"] for r in rows), default=None)
    out = []
    for r in rows:
        mean = ranged(r["ndcg_at_k"], r["ndcg_ci"])
        same = not any(r["delta_ci"]) and not round(r["delta"], 3)
        out.append([r["config"], f"{mean} *" if r["ndcg_at_k"] == ahead else mean, "baseline" if same else ranged(r["delta"], r["delta_ci"], SHIFT)])
        out[-1] += [shown(r[m], style) for m, style in (("recall_at_5", MEAN), ("recall_at_k", MEAN), ("mrr_at_k", MEAN), ("distinct_docs", COUNT))]
    head = ["configuration", f"nDCG@{k} (95 % of resamples)", "shift from the baseline", "recall@5", f"recall@{k}", f"MRR@{k}", f"documents@{k}"]
    return table(head, out) + "\n\n\\* best"


def source_table(rows: Sequence[dict[str, Any]], k: int) -> str:
    """nDCG and recall of each configuration (down) by source of the query (across)."""
    cells = {(r["config"], r["source"]): f"{shown(r['ndcg_at_k'])}, {shown(r['recall_at_k'])}" for r in rows}
    across = sorted({source for _, source in cells})
    down = list(dict.fromkeys(config for config, _ in cells))
    return table([f"nDCG@{k}, recall@{k}", *across], [[config, *(cells.get((config, s), "") for s in across)] for config in down])


def diversity_table(rows: Sequence[dict[str, Any]], k: int) -> str:
    """How many documents a list holds and how alike its entries are."""
    return table(["configuration", f"documents@{k}", f"likeness within the list@{k}"], [[r["config"], shown(r["distinct_docs"], COUNT), shown(r.get("ils"))] for r in rows])


def markdown(summary: Sequence[dict[str, Any]], by_source: Sequence[dict[str, Any]], meta: dict[str, Any], latency: dict[str, float] | None = None) -> str:
    """The report: facts (purity and topics among them, if ``meta`` has them), and a section for each table."""
    k = meta.get("k", 10)
    parts = ["# Retrieval ablation", "\n".join(f"- {name}: {value}" for name, value in meta.items()), summary_table(summary, k)]
    parts += ["## By source", source_table(by_source, k), "## Diversity", diversity_table(summary, k)]
    if latency:
        parts += ["## Milliseconds a query, over the batch", table(["configuration", "ms"], [[name, shown(ms, COUNT)] for name, ms in latency.items()])]
    return "\n\n".join(parts) + "\n"


def write_report(folder: str, summary: Sequence[dict[str, Any]], by_source: Sequence[dict[str, Any]], scores: Sequence[dict[str, Any]], meta: dict[str, Any], latency: dict[str, float] | None = None) -> Path:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    per_query: dict[str, list] = {}
    for s in scores:
        per_query.setdefault(s["config"], []).append(s)
    (out / "evaluation.json").write_text(json.dumps({"meta": meta, "summaries": list(summary), "per_query": per_query, "latency_ms": latency or {}}, indent=1, default=str))
    (out / "evaluation.md").write_text(markdown(summary, by_source, meta, latency))
    for dark in (False, True):
        (out / f"evaluation-{'dark' if dark else 'light'}.svg").write_text(chart(summary, dark))
    return out / "evaluation.md"


def chart(rows: Sequence[dict[str, Any]], dark: bool) -> str:
    """A dot and interval for each configuration, as SVG."""
    ink, paper, dot = ("#e6e6e6", "#14171a", "#7ab8ff") if dark else ("#222222", "#ffffff", "#1f6fb2")
    ends = [x for r in rows for x in r["ndcg_ci"]] or [0, 1]
    low, high = min(ends), max(ends)
    x = lambda v: 240 + 380 * (v - low) / ((high - low) or 1)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="660" height="{40 + 28 * len(rows)}" font-family="sans-serif" font-size="13"><rect width="100%" height="100%" fill="{paper}"/>']
    for i, r in enumerate(rows):
        y = 30 + 28 * i
        parts.append(f'<text x="10" y="{y + 4}" fill="{ink}">{r["config"]}</text><line x1="{x(r["ndcg_ci"][0]):.1f}" x2="{x(r["ndcg_ci"][1]):.1f}" y1="{y}" y2="{y}" stroke="{dot}" stroke-width="2"/><circle cx="{x(r["ndcg_at_k"]):.1f}" cy="{y}" r="5" fill="{dot}"/>')
    return "".join([*parts, "</svg>"])


def update_section(readme: str, section: str) -> bool:
    """Replace what stands between the markers; False (and no change) where they are missing."""
    path = Path(readme)
    text = path.read_text()
    if BEGIN not in text or END not in text:
        return False
    head, rest = text.split(BEGIN, 1)
    path.write_text(f"{head}{BEGIN}\n{section}\n{END}{rest.split(END, 1)[1]}")
    return True
