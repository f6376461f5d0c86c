import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.errors import ConfigurationError
from harrow.operators import chunking as C
from harrow.options import ChunkingOptions

ARTICLE = "The lead is short.\n\n== First ==\nOne two three four five.\nSix seven eight.\n=== Deep ===\nNine ten.\n\n  == Second ==  \nEleven twelve thirteen.\n# not a heading here\n"


def brute_pack(costs, gaps, sections, limit, overlap):
    """The rules of packing, step by step, on lists of unit numbers."""
    size = lambda run: sum(costs[i] for i in run) + sum(gaps[i] for i in run[1:])
    runs, run = [], []
    for i in range(len(costs)):
        if run:
            change = sections[i] != sections[run[-1]]
            if size([*run, i]) > limit or (change and size(run) >= limit // 2):
                runs.append(run)
                tail = []
                if not change and sections[run[0]] == sections[i]:
                    room = min(overlap, limit - gaps[i] - costs[i])
                    for first in range(1, len(run)):
                        if size(run[first:]) <= room:
                            tail = run[first:]
                            break
                run = tail
        run = [*run, i]
    return [(r[0], r[-1] + 1) for r in [*runs, run] if r]


def test_pack_equals_the_rules_step_by_step():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(0, 30)
        costs = [rng.randint(0, 40) for _ in range(n)]
        gaps = [0] * bool(n) + [rng.randint(0, 3) for _ in range(n - 1)]
        sections = sorted(rng.choice("abc") for _ in range(n)) if rng.random() < 0.7 else [rng.choice([None, "a"]) for _ in range(n)]
        assert C.pack(costs, gaps, sections, 64, 16) == brute_pack(costs, gaps, sections, 64, 16)


def test_sections_fill_forward_and_headings_are_dropped():
    spans, sections = C.paragraphs(ARTICLE, markdown=False)
    assert [(ARTICLE[a:b], s) for (a, b), s in zip(spans, sections, strict=True)] == [
        ("The lead is short.", None), ("One two three four five.", "First"), ("Six seven eight.", "First"), ("Nine ten.", "Deep"), ("Eleven twelve thirteen.", "Second"), ("# not a heading here", "Second"),
    ]
    assert C.paragraphs(ARTICLE, markdown=True)[1][-1] == "Second" and len(C.paragraphs(ARTICLE, markdown=True)[0]) == 5


def test_oversized_sentences_and_giant_words():
    text = " ".join(["word"] * 100) + ". Next one here. " + "x" * 500
    chunks = C.chunk_text(text, False, 32, 4, lambda ts: [len(t.split()) for t in ts])
    assert all(t <= 32 for *_, t, _ in chunks)
    assert "Next one here." in text[chunks[-1][0] : chunks[-1][1]]
    heavy = C.chunk_text("tiny " + "y" * 50, False, 32, 4, lambda ts: [len(t) for t in ts])
    assert [t for *_, t, _ in heavy] == [4, 50]


def test_every_word_is_covered_and_spans_are_exact(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choice(["é😀", "b", "C.", "dd"]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 25))]
        rows.append((str(i), "t", "\n".join(lines), "x.txt", {"source": "s"}))
    docs = spark.createDataFrame(rows, "doc_id string, title string, text string, source_uri string, metadata map<string,string>")
    options = ChunkingOptions(max_tokens=48, overlap_tokens=12)
    out = C.chunk_documents(docs, options).collect()
    texts = {r[0]: r[2] for r in rows}
    for doc_id, text in texts.items():
        own = sorted((c for c in out if c.doc_id == doc_id), key=lambda c: c["index"])
        assert [c["index"] for c in own] == list(range(len(own)))
        seen = set()
        for c in own:
            assert c.text == text[c.char_start : c.char_end] and c.token_count <= 48
            seen |= set(range(c.char_start, c.char_end))
        assert {m for w in re.finditer(r"\S+", text) for m in range(*w.span())} <= seen
    again = {r.chunk_id for r in C.chunk_documents(docs, options).collect()}
    assert again == {c.chunk_id for c in out} and len(again) == len(out)


def test_empty_documents_are_failures(spark):
    docs = spark.createDataFrame([("a", "t", "", "x", None), ("b", "t", "== Only ==\n", "x", None), ("c", None, None, None, None), ("d", "t", "text", "x", None)], "doc_id string, title string, text string, source_uri string, metadata map<string,string>")
    chunks = C.chunk_documents(docs)
    assert {r.doc_id for r in C.empty_documents(docs, chunks).collect()} == {"a", "b", "c"}
    assert chunks.where(F.col("doc_id") == "d").count() == 1


def test_options_are_checked():
    with pytest.raises(ConfigurationError):
        ChunkingOptions(max_tokens=64, overlap_tokens=64)
    with pytest.raises(ConfigurationError):
        ChunkingOptions(max_tokens=8)
