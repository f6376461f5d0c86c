"""Vector codes, fill-in-the-middle and SentencePiece ids against plain re-implementations, SQL and the library."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import common
from harrow.llm import infill as I
from harrow.llm import pieces as P
from harrow.llm import vector_codes as V
from harrow.llm.queries import ORACLE_SQL, QUERIES

from .conftest import make_docs

VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, label_error string, harrow_label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error) of (vec_id, vector, label), and the books: everything with Python's integers."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return [], None
    d = len(rows[0][1])
    rows = [(i, [min(max(math.floor(scale * x), -V.LARGEST), V.LARGEST) for x in v], label) for i, v, label in rows if len(v) == d]
    bounds = [p * d // parts for p in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    books = [[cut(v)[p] for _, v, _ in rows[:entries]] for p in range(parts)]

    def best(v):
        return [min((sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)), k) for k, entry in enumerate(book)) for part, book in zip(cut(v), books, strict=True)]

    for _ in range(rounds):
        found = [(cut(v), best(v)) for _, v, _ in rows]
        new = [[list(e) for e in book] for book in books]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, b in found if b[p][1] == k]
                if own:
                    new[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    coded = [(i, "".join(f"{k:02x}" for _, k in best(v)), sum(e for e, _ in best(v)), label) for i, v, label in rows]
    totals = {}
    for _, _, e, label in coded:
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, c, e, totals[label]) for i, c, e, label in coded], digest


def odd_vectors(n, d, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(d)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(n + k, rows[0][1], 1) for k in range(40)]  # a group of equal vectors
    rows += [(3, rows[4][1], 2), (3, rows[3][1], 3), (None, rows[5][1], None), (n + 50, [0.0] * d, None), (n + 51, [2.0**-12] * d, 1)]
    rows += [(-1, None, 1), (-2, [None, *rows[0][1][1:]], 1), (-3, [float("nan"), *rows[0][1][1:]], 1), (-4, [float("-inf"), *rows[0][1][1:]], 1), (-5, [], None), (n + 52, [1.0] * (d + 1), 1)]
    return rows


@pytest.mark.parametrize(("n", "d"), [(150, 64), (60, 13), (4, 16), (30, 3)])
def test_codes_are_those_of_plain_integers(spark, tmp_path, monkeypatch, n, d):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    rows = odd_vectors(n, d)
    df = spark.createDataFrame([(*r, "x", 0, "y", 3) for r in rows], VECTORS)
    df.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    wanted, digest = plain_codes(rows)
    got = V.op11_vector_codes(spark, str(tmp_path)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(wanted, key=order)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_coded_rows_keep_their_columns_and_decode_near(spark):
    df = spark.createDataFrame([(*r, "x", 0, "y", 3) for r in odd_vectors(80, 16)], VECTORS)
    books = V.fit_codebooks(df)
    coded = V.with_label_error(V.encode_vectors(df, books))
    assert set(coded.columns) == {c for c in df.columns if c != "harrow_label"} | {"label_error"} and dict(coded.dtypes)["label_error"] == "bigint"
    for r in V.decode_vectors(coded, books).collect():
        off = np.floor(np.array(r.embedding) * books.scale) - (np.array(r.decoded) * books.scale - 0.5)
        assert round(float((off**2).sum())) == r.error


def test_codes_of_nothing_and_of_huge_components(spark, tmp_path):
    empty = spark.createDataFrame([], VECTORS)
    assert V.fit_codebooks(empty) is None
    empty.write.parquet(str(tmp_path / "embeddings.parquet"))
    df = V.op11_vector_codes(spark, str(tmp_path))
    assert df.count() == 0 and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(i, [1e300 if i % 2 else -1e300] * 8, 1) for i in range(40)]
    books = V.fit_codebooks(spark.createDataFrame([(*r, "x", 0, "y", 3) for r in rows], VECTORS))
    assert abs(books.entries[0]).max() == V.LARGEST
    with pytest.raises(ValueError):
        V.fit_codebooks(empty, entries=300)


MARKED = [(20, "<P> in it\nb", "a"), (21, "half < P>\n<\nS>\n<M", "a"), (22, "no line feed", "a"), (23, "\n", "a"), (24, "\n\n\n", "a"), (25, "é\n😀\nend", "a"), (26, "<\n" * 50, "a"), (27, "\r\n\x0b x\n", "a"), (28, "a<M>", "a")]


def plain_infill(doc_id, text, options):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if options.unit == "line" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"{options.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (options.prefix, options.suffix, options.middle)) or h3 % 100 >= options.rate:
        return n, "plain", None, None, text
    if h4 % 100 < options.spm_rate:
        return n, "spm", len(p), len(m), options.suffix + s + options.prefix + p + options.middle + m
    return n, "psm", len(p), len(m), options.prefix + p + options.suffix + s + options.middle + m


@pytest.mark.parametrize("options", [I.InfillOptions(), I.InfillOptions(unit="character", rate=60, seed=3), I.InfillOptions(prefix="\\Ea", suffix="\\Q.", middle="\\b*", spm_rate=20)])
def test_infill_is_the_plain_rule_and_comes_back(spark, monkeypatch, odd_rows, options):
    monkeypatch.setattr(I, "BLOCK_BYTES", 64)
    rng = random.Random(3)
    more = [(100 + i, "".join(rng.choice("ab\n<PSM>é \\EQ.😀") for _ in range(rng.randrange(60))), "a") for i in range(300)]
    docs = make_docs(spark, odd_rows + MARKED + more).selectExpr("*", "'old' as form", "1 as n", "2 as harrow_draw")
    got = I.fill_in_middle(docs, options).withColumn("back", I.restored(options=options)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text, options), (r.doc_id, r.text)
        assert r.back == I.restore(r.output, r.form, options) == (r.text or "") and r.source in (None, "a", "b", "c") and r.sid == 7
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert I.fill_in_middle(docs.where("false"), options).count() == 0


def test_infill_query_and_its_sql(spark, odd_rows, tmp_path):
    docs = make_docs(spark, odd_rows + MARKED)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = I.op12_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(ORACLE_SQL["op12_fill_in_middle"])
    names = [d[0] for d in cursor.description]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.collect()), key=order) == sorted((tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()), key=order)


def test_markers_that_blur_are_refused():
    for bad in ({"prefix": ""}, {"prefix": "<S"}, {"prefix": "<S>"}, {"prefix": "x<"}, {"middle": "aba"}, {"unit": "page"}):
        with pytest.raises(ValueError):
            I.InfillOptions(**bad)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.public_model())


TEXTS = ["", " ", "   ", "a", " a", "  a  b ", "a▁b", "▁▁ x", "\n\n a\tb\r\n", "<s> </s> <unk> <0x41>", "ﬁne Ｆ é é", "　x y", "\x00\x01", "1234567890 12.5", "日本語のテキスト 한국어", "😀😀 👩‍👩‍👧", "aaaaaaaaaaaaaaaaaaa", "return  self.x_y == {'a': [1]};", "ÀÉÎÕÜ straße", "a" * 3000 + "▁" * 500 + " " * 700]


def test_pieces_are_the_library_s(spark, library, odd_rows, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 200)
    docs = make_docs(spark, odd_rows + [(100 + i, t, "a") for i, t in enumerate(TEXTS)]).selectExpr("*", "'old' as ids", "1 as decoded")
    got = P.decode_pieces(P.encode_pieces(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or ""), r.text
        assert r.decoded == library.decode(r.ids) and r.sid == 7
    assert P.decode_pieces(P.encode_pieces(docs.where("false"))).count() == 0


def test_the_query_of_pieces_returns_the_contract(spark, library, odd_rows, tmp_path):
    make_docs(spark, odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = []
    for i, t, _ in odd_rows:
        ids = library.encode(t or "")
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    df = QUERIES["op13_sentencepiece"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, df.collect()), key=order) == sorted(wanted, key=order)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abehilnorst ▁ABTé.,'-_\n01日😀", max_size=40) | st.text(max_size=15), max_size=6))
def test_pieces_of_any_text(texts):
    import pyarrow as pa

    library, own = LIBRARY[0], P.coder(P.public_model())
    texts = [t for t in texts if t.isprintable() or all(not 0xD800 <= ord(c) <= 0xDFFF for c in t)]
    for i, j, ids, counts in own.encode_column(pa.array(texts, pa.string())):
        at = np.concatenate(([0], np.cumsum(counts)))
        wanted = [library.encode(t) for t in texts[i:j]]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == wanted
        assert own.decode_block(ids, counts).to_pylist() == [library.decode(w) for w in wanted]


LIBRARY = []


@pytest.fixture(autouse=True, scope="module")
def _keep(library):
    LIBRARY.append(library)


def test_decoding_of_any_ids(library):
    own, rng = P.coder(P.public_model()), random.Random(8)
    odd = [0, 1, 2, *range(3, 259), library.piece_to_id("▁"), library.piece_to_id("▁▁"), library.piece_to_id("▁a"), 500, 31000]
    lists = [[], [1], [1, library.piece_to_id("▁a")], [library.piece_to_id("▁"), library.piece_to_id("▁a")]]
    lists += [[rng.choice(odd) for _ in range(rng.randrange(9))] for _ in range(3000)]
    lists += [[rng.randrange(32000) for _ in range(rng.randrange(30))] for _ in range(500)]
    lists += [[3 + b for b in "é😀日".encode()], [3 + 0xE2, 3 + 0x96, 300], [3 + 0xED, 3 + 0xA0, 3 + 0x80]]
    counts = np.array([len(x) for x in lists])
    got = own.decode_block(np.array([i for x in lists for i in x]), counts).to_pylist()
    for ids, text in zip(lists, got, strict=True):
        assert text == library.decode(ids) == own.decode_ids(ids).decode(), ids
    with pytest.raises(ValueError):
        own.decode_block(np.array([40_000]), np.array([1]))


def test_last_pieces_are_those_of_the_merges():
    own, rng = P.coder(P.public_model()), random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice("abcdeinorst ") for _ in range(rng.randrange(1, 25)))
        assert [own.texts[i] for i in own.stretch_ids(text)] == own.merged(text)


def test_staging_gives_memory_back(spark, monkeypatch):
    jvm, cycle = spark.sparkContext._jvm, []
    cycle += [cycle, jvm.java.util.ArrayList()]
    kept = jvm.java.lang.ref.WeakReference(cycle[1])
    del cycle
    monkeypatch.setattr(common, "_released", 0.0)
    common.staged(spark.range(3), "some")
    assert common._released > 0 and kept.get() is None
