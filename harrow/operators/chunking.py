"""Structure-aware chunking: lines, sentences, word windows, packed to a token budget.

One document is one row of work and nothing is shuffled. Units are held as columns of
numbers; the cost of any run of units comes from prefix sums, so a chunk is a pair of
unit positions and its overlap a binary search.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running
from ..functions.text import CHUNK_NAMESPACE
from ..options import ChunkingOptions

TokenCounter = Callable[[Sequence[str]], list[int]]

# What a heading and a sentence boundary look like.
WIKI_HEADING = re.compile(r"(={2,6})\s*(.+?)\s*\1\s*")
MARKDOWN_HEADING = re.compile(r"#{1,6}\s+(.+?)\s*")
SENTENCE_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
_WORD = re.compile(r"\S+")


def word_counter(texts: Sequence[str]) -> list[int]:
    """The offline token counter: words by white space."""
    return [len(t.split()) for t in texts]


def heading_of(line: str, markdown: bool) -> str | None:
    """The section that a trimmed line opens, if it is a heading."""
    if found := WIKI_HEADING.fullmatch(line):
        return found[2]
    if markdown and (found := MARKDOWN_HEADING.fullmatch(line)):
        return found[1]
    return None


def paragraphs(text: str, markdown: bool) -> tuple[list[tuple[int, int]], list[str | None]]:
    """Spans of the non-blank lines that aren't headings, and the section of each."""
    spans, sections, section, at = [], [], None, 0
    for line in text.split("\n"):
        body = line.strip()
        if body:
            opened = heading_of(body, markdown)
            if opened is None:
                start = at + line.index(body[0])
                spans.append((start, start + len(body)))
                sections.append(section)
            else:
                section = opened
        at += len(line) + 1
    return spans, sections


def _windows(costs: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Greedy runs of words within ``limit``; a dearer word is a run of its own."""
    total, begin = [0, *accumulate(costs)], 0
    while begin < len(costs):
        end = max(begin + 1, bisect_right(total, total[begin] + limit) - 1)
        yield begin, end
        begin = end


def _finer(text: str, spans: list[tuple[int, int]], costs: list[int], limit: int, cut, count: TokenCounter):
    """(origin, span, cost, is_piece): spans over the limit give way to the pieces ``cut`` makes of them."""
    for i, ((a, b), cost) in enumerate(zip(spans, costs, strict=True)):
        if cost <= limit:
            yield i, (a, b), cost
        else:
            yield from ((i, span, c) for span, c in cut(text, a, b, limit, count))


def _sentences(text: str, a: int, b: int, limit: int, count: TokenCounter):
    """Sentences of ``text[a:b]`` with their costs; one over the limit as runs of its words."""
    own = text[a:b]
    # A sentence is what a break, or the end, closes; white space at its end is the break's.
    closed = [(m.start(), m.end()) for m in SENTENCE_BREAK.finditer(own)] + [(len(own.rstrip()), len(own))]
    starts = [0, *(after for _, after in closed)]
    spans = [(a + s, a + e) for s, (e, _) in zip(starts, closed, strict=False) if own[s:e].strip()]
    for _, span, cost in _finer(text, spans, count([text[s:e] for s, e in spans]), limit, _word_runs, count):
        yield span, cost


def _word_runs(text: str, a: int, b: int, limit: int, count: TokenCounter):
    words = [(a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])]
    costs = count([text[s:e] for s, e in words])
    for i, j in _windows(costs, limit):
        yield (words[i][0], words[j - 1][1]), sum(costs[i:j])


def pack(costs: Sequence[int], gaps: Sequence[int], sections: Sequence[str | None], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of units (begin, end) that make the chunks.

    A run closes when the next unit would overflow it, or opens another section while
    the run is at least half full. After a section change the next run starts afresh;
    else it starts with the longest tail of the closed run, never all of it, that fits
    both the overlap and the room the next unit leaves, if the run began in the
    unit's section. ``gaps``: cost of the text before a unit, paid inside a run only.
    """
    paid = [0, *accumulate(c + g for c, g in zip(costs, gaps, strict=True))]
    runs, begin = [], 0
    for i in range(1, len(costs)):
        size = paid[i] - paid[begin] - gaps[begin]
        new_section = sections[i] != sections[i - 1]
        if size + gaps[i] + costs[i] <= limit and not (new_section and size >= limit // 2):
            continue
        runs.append((begin, i))
        if new_section or sections[begin] != sections[i]:
            begin = i
        else:
            room = min(overlap, limit - gaps[i] - costs[i])
            tails = range(begin + 1, i)
            begin += 1 + bisect_left(tails, -room, key=lambda t: -(paid[i] - paid[t] - gaps[t]))
    if costs:
        runs.append((begin, len(costs)))
    return runs


def chunk_text(text: str, markdown: bool, limit: int, overlap: int, count: TokenCounter) -> list[tuple[int, int, int, str | None]]:
    """(start, end, tokens, section) of a text's chunks, in order; none for a text without content."""
    spans, sections = paragraphs(text, markdown)
    if not spans:
        return []
    fine = list(_finer(text, spans, count([text[a:b] for a, b in spans]), limit, _sentences, count))
    units, costs, own = [u for _, u, _ in fine], [c for _, _, c in fine], [sections[i] for i, _, _ in fine]
    gaps = [0, *count([text[a[1] : b[0]] for a, b in zip(units[:-1], units[1:], strict=True)])]
    paid = [0, *accumulate(c + g for c, g in zip(costs, gaps, strict=True))]
    return [(units[i][0], units[j - 1][1], paid[j] - paid[i] - gaps[i], own[i] or None) for i, j in pack(costs, gaps, own, limit, overlap)]


_CHUNKS = pa.schema(
    [("chunk_id", pa.string()), ("doc_id", pa.string()), ("index", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())]
    + [("title", pa.string()), ("source_uri", pa.string()), ("content_hash", pa.string()), ("section", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))]
)
_CHUNKS_SQL = "chunk_id string, doc_id string, index int, text string, token_count int, char_start int, char_end int, title string, source_uri string, content_hash string, section string, metadata map<string,string>"


def _chunk_rows(batches: Iterator[pa.RecordBatch], options: ChunkingOptions, count: TokenCounter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, title, text, uri, metadata in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            digest = hashlib.sha256(f"{title}\n{text}".encode()).hexdigest()
            for index, (a, b, tokens, section) in enumerate(chunk_text(text, uri.endswith(".md"), options.max_tokens, options.overlap_tokens, count)):
                own = dict(metadata or [])
                if section:
                    own["section"] = section
                rows.append((str(uuid.uuid5(CHUNK_NAMESPACE, f"{doc_id}:{digest}:{index}")), doc_id, index, text[a:b], tokens, a, b, title, uri, digest, section, list(own.items())))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)


def chunk_documents(docs: DataFrame, options: ChunkingOptions | None = None, count: TokenCounter = word_counter) -> DataFrame:
    """Chunks of (doc_id, title, text, source_uri, metadata); a document without content has none.

    ``#`` lines are headings only where the address ends in ``.md``. Nulls count as empty text.
    """
    options = options or ChunkingOptions()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("doc_id"), text("title"), text("text"), text("source_uri"), F.col("metadata").cast("map<string,string>"))
    return rows.mapInArrow(partial(_chunk_rows, options=options, count=count), _CHUNKS_SQL)


def empty_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, reason) of documents that gave no chunk; what the index holds of them stays."""
    return docs.select("doc_id").distinct().join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("reason", F.lit("no text to index"))


def line_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, start, end): the non-blank lines, trimmed, with code-point offsets; JVM only, in time that grows with the lines."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    placed = docs.select(id_col, lines.alias("bodies")).select(id_col, "bodies", F.expr(running("bodies", "length(e) + 1")).alias("begins"))
    rows = placed.select(id_col, F.posexplode(F.arrays_zip(F.col("bodies").alias("body"), F.col("begins").alias("at")))).select(id_col, F.col("pos").alias("line"), "col.body", "col.at")
    left = F.length("body") - F.length(F.regexp_replace("body", r"(?U)^\s+", ""))
    size = F.length(F.regexp_replace("body", r"(?U)^\s+|\s+$", ""))
    return rows.withColumn("start", F.col("at") + left).withColumn("end", F.col("at") + left + size).where(size > 0).select(id_col, F.col("line").cast("bigint").alias("line"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, section, body): content lines with the section they stand in (fill-forward)."""
    from pyspark.sql import Window

    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw")).withColumn("body", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where("body <> ''")
    opened = F.nullif(F.regexp_extract("body", r"^(={2,6})\s*(.+?)\s*\1$", 2), F.lit(""))
    order = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("opened", opened).withColumn("section", F.last("opened", ignorenulls=True).over(order)).where("opened is null")
    return rows.select(id_col, F.col("line").cast("bigint").alias("line"), "section", "body")
