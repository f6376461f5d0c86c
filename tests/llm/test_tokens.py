import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from harrow.llm import packing, token_files
from harrow.llm.tokens import ChunkEncoder

from .conftest import make_docs

TEXTS = ["", " ", "  a  b ", "a\n\nb", "\ta b", "a \n b", "foo's bar'll", "<|endoftext|> x", "é́ á ́b", "a\xa0 b", "x \xa0b", "ΑΣ ΣΑΣ İ", "\n", "a\n", "x\r\ny", "Straße, naïve.", "of%%% a*** that.\" (foo) _x_", "y" * 200 + " z", "ﬁ Ǆ ½ 10,000"]


@pytest.mark.parametrize(("path", "kind"), [(packing.word_bpe, "dropped"), (token_files.byte_bpe, "leading")])
def test_ids_are_the_tokenizers(path, kind, words):
    coder = ChunkEncoder(path(), kind)
    texts = [*TEXTS, None, " ".join(words[:400]), *[f"{a}, {b}.\n{a.title()}" for a, b in zip(words[:100], words[100:200], strict=True)]]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, coder.code).tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def ids_of(path, end, text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("window", "grain"), [(2048, 128), (64, 48), (16, 16)])
def test_packing_places_every_id_once(spark, odd_rows, words, window, grain):
    rows = odd_rows + [(100 + i, " ".join(words[i : i + 3 * i]), f"s{i % 4}") for i in range(40)]
    docs = make_docs(spark, rows).repartition(3, "doc_id")
    pieces = packing.pack(docs, window=window, grain=grain).collect()
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in stream:
        assert p.sequence_id * window + p.offset == at and p.offset + p.length <= window and len(p.ids) == 4 * p.length
        at += p.length
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.source), []).append(p)
    for (doc_id, source), own in by_doc.items():
        texts = [t for i, t, s in rows if i == doc_id and s == source]
        wanted = ids_of(packing.word_bpe(), 1, texts[0])
        own.sort(key=lambda p: p.start)
        if len(texts) == 1:
            assert b"".join(p.ids for p in own) == wanted.tobytes() and all(p.doc_tokens == len(wanted) for p in own)
        else:
            assert sum(p.length for p in own) == len(texts) * len(wanted)
    assert len({(i, s) for i, _, s in rows}) == len(by_doc)


def test_every_window_keeps_the_shares(spark, words):
    rows = [(i, " ".join(words[i : i + 60]), "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(600)]
    docs = make_docs(spark, rows).repartition(5, "doc_id")
    for weights in (None, {"a": 1, "b": 1, "c": 1}):
        pieces = packing.pack(docs, weights=weights, window=512, grain=32)
        table = pieces.groupBy("sequence_id").pivot("source", ["a", "b", "c"]).agg(F.sum("length")).fillna(0).orderBy("sequence_id").collect()
        totals = [sum(r[s] for r in table) for s in "abc"]
        share = [t / sum(totals) for t in totals] if weights is None else [1 / 3] * 3
        drained = 0
        for r in table[:-1]:
            drained += any(r[s] == 0 for s in "abc")
            if not drained and (weights is None or r.sequence_id < 3):
                assert all(abs(r[s] - 512 * w) <= 2 * 32 + 1 for s, w in zip("abc", share, strict=True))


def test_token_files_round_trip(spark, odd_rows, tmp_path):
    docs = make_docs(spark, odd_rows)
    for mode, block, size in (("byte", 1 << 16, 1 << 23), ("bit", 100, 5000)):
        path = str(tmp_path / mode)
        token_files.write_token_files(docs, path, mode=mode, block=block, file_ids=size)
        rows = token_files.document_starts(token_files.read_token_files(spark, path)).collect()
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((i for i, _, _ in odd_rows), key=lambda i: (i is not None, i or 0))
        at = 0
        wanted = {}
        for i, t, _ in odd_rows:
            wanted.setdefault(i, ids_of(token_files.byte_bpe(), 2, t))
        for r in rows:
            assert r.start == at and r.n_tokens == len(wanted[r.doc_id]) and zlib.crc32(r.ids) == zlib.crc32(wanted[r.doc_id].tobytes())
            at += r.n_tokens
        images = [x for f in (tmp_path / mode).iterdir() if f.name.startswith("part-") for x in pq.read_table(f)["image"].to_pylist()]
        assert images and all(x.startswith(token_files.HEAD) and token_files.file_tail(x)[3] for x in images)


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 2, 255, 256, 50_000, 1 << 31):
        ids = rng.integers(0, top, 1000, dtype=np.uint32)
        for mode in ("bit", "byte"):
            assert (token_files.from_planes(token_files.to_planes(ids, mode), len(ids), mode) == ids).all()
    with pytest.raises(ValueError):
        token_files.file_tail(b"x" * 64)


def test_empty_tables(spark, tmp_path):
    empty = make_docs(spark, [(1, "x", "s")]).where("false")
    assert packing.pack(empty).count() == 0
    token_files.write_token_files(empty, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def round_robin(docs, weights, grain, window):
    """Pieces (doc, start, length, sequence, offset), served one quantum at a time with deficit counters held as fractions."""
    left, deficit = {k: [(d, 0, n) for d, n in own] for k, own in docs.items()}, dict.fromkeys(docs, Fraction(0))
    at, out = 0, []
    while any(left.values()):
        live = [k for k in left if left[k]]
        wait = min((grain - deficit[k]) / weights[k] for k in live)
        for k in live:
            deficit[k] += weights[k] * wait
        for k in sorted(live):  # all that have reached a quantum, smallest first
            if deficit[k] < grain:
                continue
            deficit[k] -= grain
            due = grain
            while due and left[k]:
                d, start, n = left[k].pop(0)
                size = min(due, n, window - at % window)
                if out and out[-1][0] == d and out[-1][3] == at // window and at % window and out[-1][1] + out[-1][2] == start:
                    out[-1] = (d, out[-1][1], out[-1][2] + size, *out[-1][3:])
                else:
                    out.append((d, start, size, at // window, at % window))
                at, due = at + size, due - size
                if n > size:
                    left[k].insert(0, (d, start + size, n - size))
    return out


@pytest.mark.parametrize("weights", [None, 0.5, {"a": 5, "b": 1, "c": 2}, {"c": 0.01}])
def test_packing_is_deficit_round_robin_step_by_step(spark, words, weights):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice("aaab" if i < 40 else "bcc")) for i in range(80)]
    docs = make_docs(spark, rows).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    got = packing.pack(docs, weights=weights, window=256, grain=32).collect()
    queues = {}
    for i, t, s in rows:
        queues.setdefault(s, []).append((i, len(ids_of(packing.word_bpe(), 1, t))))
    totals = {s: sum(n for _, n in own) for s, own in queues.items()}
    natural = {s: n / sum(totals.values()) for s, n in totals.items()}
    share = {s: weights.get(s, natural[s]) for s in natural} if isinstance(weights, dict) else {s: x ** (weights or 1.0) for s, x in natural.items()}
    whole = {s: Fraction(max(1, round(x / sum(share.values()) * (1 << 20)))) for s, x in share.items()}
    wanted = round_robin(queues, whole, 32, 256)
    assert sorted((p.doc_id, p.start, p.length, p.sequence_id, p.offset) for p in got) == sorted(wanted)


def test_many_sources(spark, words):
    rows = [(i, " ".join(words[i : i + 5]), f"s{i % 1500}") for i in range(1600)]
    pieces = packing.pack(make_docs(spark, rows)).agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert pieces[1] == 1600


def test_the_token_queries_return_their_contracts(spark, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 5] + [(5, "one", "b")]
    make_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: t for i, t, _ in rows}
    pieces = packing.op3_packing(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces.columns) and all(t == "bigint" for c, t in pieces.dtypes if c != "source")
    known = {i: ids_of(packing.word_bpe(), 1, t) for i, t in texts.items()}
    for p in pieces.collect():
        ids = known[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    found = token_files.op8_bit_plane_output(spark, str(tmp_path))
    assert dict(found.dtypes) == dict.fromkeys(["doc_id", "start", "n_tokens", "ids_crc32"], "bigint")
    at = 0
    for r in found.orderBy("doc_id").collect():
        ids = ids_of(token_files.byte_bpe(), 2, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
