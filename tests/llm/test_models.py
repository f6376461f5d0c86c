"""Fingerprints, nearest neighbours and the trained classifiers."""

import bisect
import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from harrow.llm import ann as A
from harrow.llm import order_minhash as O
from harrow.llm import quality as Q
from harrow.llm import toxicity as X
from harrow.llm.linear import TrainingSet, fit_logistic, sigmoid
from harrow.llm.words import utf8

from .conftest import make_docs


def test_fingerprints_follow_edits(words):
    rng = random.Random(7)
    text = " ".join(rng.choices(words, k=400))
    one = O.sketch(text)
    assert O.likeness(one, O.sketch(text)) == 1.0
    small, large = text[:-30] + "q" * 30, text[: len(text) // 2] + " ".join(rng.choices(words, k=200))
    assert O.likeness(one, O.sketch(small)) > O.likeness(one, O.sketch(large)) > O.likeness(one, O.sketch(" ".join(rng.choices(words, k=400))))
    half = len(text) // 2
    turned = text[half:] + text[:half]
    assert O.likeness(one, O.sketch(turned)) < 0.9  # the same pieces in another order
    assert O.shown(O.sketch("")) == O.EMPTY and O.likeness(None, None) == 1.0 and O.likeness(None, one) == 0.0
    assert O.likeness(O.sketch("abc"), O.sketch("abc")) == 1.0 and len(O.shown(O.sketch("a" * 5000))) == 8 * O.PERMUTATIONS


def test_selection_equals_taking_the_smallest(words):
    for text in (" ".join(words[:900]), "ab" * 3000, "x", "abcdefghi"):
        items, at = O.items_of([text])
        wanted = []
        for flip, times in zip(O._FLIP[:, 0].tolist(), O._TIMES[:, 0].tolist(), strict=True):
            rank = [((int(x) >> 32) ^ flip) * times % (1 << 32) for x in items]
            own = sorted(sorted(range(len(rank)), key=lambda i: (rank[i], i))[:2])
            wanted.append(own)
        chosen = O.select(items, at[:1], at[1:], at[:1])[0].T.tolist()
        assert [sorted(x & 0xFFFFFFFF for x in c if x != (1 << 64) - 1) for c in chosen] == wanted
        for cut in (0, 1, 7, len(text) // 2, len(text)):
            edited = text[:cut] + "another end, " * 30
            assert [O.shown(x[0]) for x in O.sketches_of_edits([text, ''], [edited, ''], [cut, 0])] == [O.shown(O.sketch(text)), O.shown(O.sketch(edited))]
    again = O.numbered(np.array([5, 9, 5, 5, 9], np.uint64))
    assert len(set(again.tolist())) == 5 and again[0] == 5 and again[1] == 9


def order_of(row):
    return row[0] is not None, row[0] or 0, np.uint64(xxhash.xxh64(row[1].encode(), seed=42).intdigest()).astype(np.int64)


def hold_edits(got, rows):
    """``got`` are the rows that ``rows`` (doc_id, text) must give."""
    rows = sorted(((i, t or "") for i, t in rows), key=order_of)
    wanted = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other = O.sketch(t), O.sketch(edited)
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), O.shown(own), O.shown(other), O.likeness(own, other), O.likeness(own, O.sketch(after))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("parts", [4, 211, 4000])
def test_edited_texts(spark, odd_rows, words, parts):
    rng = random.Random(14)
    rows = [(i, t) for i, t, _ in odd_rows] + [(100 + i, " ".join(rng.choices(words, k=5))) for i in range(300)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        hold_edits(O.compare_with_edits(make_docs(spark, [(i, t, "s") for i, t in rows])).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot", [[(None, "a much repeated text")], [(7, None)], [(400, "the same words over and over"), (401, "the next")], [(400, "x y z"), (None, "x y z")]])
def test_much_repeated_rows_spread_over_stretches(spark, words, hot):
    rng = random.Random(15)
    rows = [(rng.choice([None, i]), " ".join(rng.choices(words, k=4))) for i in range(300)] + [h for h in hot for _ in range(600)]
    rng.shuffle(rows)
    docs = make_docs(spark, [(i, t, "s") for i, t in rows])
    hold_edits(O.compare_with_edits(docs, hot_rows=100).collect(), rows)
    sizes = [r["n"] for r in O.neighbours(docs, hot_rows=100).where("not ahead").groupBy("number").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 600


def test_places_among_many_stretches():
    rng = random.Random(16)
    keys = sorted({(rng.choice([None, 5, rng.randrange(-(10**9), 10**9), rng.randrange(100)]), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(100_000)}, key=O._order)
    cut = O.Stretches(rng.sample(keys, len(keys)), [1] * len(keys))
    asked = rng.sample(keys, 2000) + [(k, h + d) for k, h in rng.sample(keys, 2000) for d in (-1, 1)] + [(None, 0), (5, 0), (6, 1), (-(10**10), 0), (10**10, 0)]
    at, exact = cut.place(pa.array([k for k, _ in asked], pa.int64()), pa.array([h for _, h in asked], pa.int64()))
    for key, i, same in zip(asked, at.tolist(), exact.tolist(), strict=True):
        place = bisect.bisect_right(keys, O._order(key), key=O._order) - 1
        assert i == max(place, 0) and same == (place >= 0 and keys[place] == key)


def test_numbers_of_stretches_and_what_closes_them():
    cut = O.Stretches([(7, 1), (None, 3), (2, 9)], [1, 2, 3])
    assert cut.numbers == 6 and cut.base.tolist() == [0, 2, 5, 6]
    assert cut.closes().to_pydict() == {"s": [0, 1, 1, 1, 2, 0], "number": [0, 1, 2, 3, 4, 5]}


def test_edits_of_few_rows(spark, odd_rows):
    assert O.compare_with_edits(make_docs(spark, odd_rows).where("false")).count() == 0
    single = O.compare_with_edits(make_docs(spark, [(1, "abcdefgh", "s")])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_fingerprint_column(spark, odd_rows):
    docs = make_docs(spark, odd_rows).withColumn("fingerprint", F.lit(0))
    got = O.with_fingerprint(docs, docs.columns).collect()
    assert len(got) == len(odd_rows) and all(r.fingerprint == O.shown(O.sketch(r.text or "")) for r in got)
    assert O.with_fingerprint(docs.where("false"), []).columns == ["fingerprint"]


def _exact(ids, x, query, k):
    s = (x * x[ids.index(query)]).sum(axis=1)
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-s[i], ids[i]))
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("scale", [0.0, 1.5])
def test_neighbours_and_recall(spark, scale):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)) + 3 * rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)) * np.exp(scale * rng.random((3000, 1)))
    x[500:900] = x[500]  # one very common vector
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    bad = [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 24, 0), (5003, [float("nan")] * 24, 0), (5004, [float("inf")] + [1.0] * 23, 0), (5005, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0), (7, rows[7][1], 0), (6000, [1.0, 2.0], 0), (6020, [2.0, 1.0], 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cell int")
    got = A.nearest(table, table.where("vec_id % 20 = 0")).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r)
    x64, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        wanted = _exact(list(range(3000)), x64, q, 20)
        own = found[q]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - x64[q] @ x64[r.vec_id]) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hits += len(set(wanted) & {r.vec_id for r in own})
    assert hits / (150 * 20) >= 0.9
    same = [r.vec_id for r in found[500]]
    assert scale or same == list(range(501, 521))
    assert [r.vec_id for r in found[6000]] == [6020] and 5000 not in found
    assert A.nearest(table.where("false"), table).count() == 0


def test_probes_that_do_not_reach_lower_the_functions(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_PROBES", 2)
    monkeypatch.setattr(A, "BUCKET_ROWS", 10)
    x = np.random.default_rng(3).standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in A.nearest(table, table.where("vec_id % 20 = 0")).collect()}
    near = x[::20] @ x.T
    near[np.arange(100), np.arange(100) * 20] = -9
    wanted = {(q * 20, int(i)) for q in range(100) for i in np.argsort(-near[q])[:20]}
    recall = len(got & wanted) / len(wanted)
    assert recall >= 0.95, recall


def test_a_query_far_from_all_gets_its_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET_ROWS", 2)
    rng = np.random.default_rng(4)
    x = np.eye(16)[0] + 0.01 * rng.standard_normal((3000, 16))
    far = -np.eye(16)[0] + 0.3 * np.eye(16)[1]
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], schema)
    # The fit follows the many queries that lie among the rows.
    asked = spark.createDataFrame([(9000, far.tolist())] + [(i, x[i].tolist()) for i in range(150)], schema)
    got = A.nearest(table, asked).where("query_id = 9000").orderBy("rank").collect()
    assert [r.vec_id for r in got] == np.argsort(-(x @ far), kind="stable")[:20].tolist(), len(got)


def test_probe_order():
    inside = np.array([[0.1, 0.5, 0.95], [0.7, 0.2, 0.4]])
    for own, moves in zip(inside, A.probe_moves(inside, 27), strict=True):
        cost = [sum((own[j] if d < 0 else 1 - own[j]) ** 2 for j, d in enumerate(m) if d) for m in moves]
        assert len({tuple(m) for m in moves}) == 27 and cost == sorted(cost) and not moves[0].any()
    rng = np.random.default_rng(5)
    inside = rng.random((20, 6))
    for own, moves in zip(inside, A.probe_moves(inside, 40), strict=True):
        cost = [sum((own[j] if d < 0 else 1 - own[j]) ** 2 for j, d in enumerate(m) if d) for m in moves]
        every = sorted(sum((own[j] if d < 0 else 1 - own[j]) ** 2 for j, d in enumerate(m) if d) for m in itertools.product((-1, 0, 1), repeat=6))
        assert cost == sorted(cost) and len({tuple(m) for m in moves}) == 40
        assert cost[-1] <= every[60]  # the true order's first 40 are among the first 60 or so


@pytest.mark.parametrize("n", [1, 2, 18, 21])
def test_few_rows_give_every_candidate(spark, n):
    for seed in (1, 2):
        x = np.random.default_rng([n, seed]).standard_normal((n, 16)).astype(np.float32)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {}
        for r in A.nearest(table, table).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: _exact(list(range(n)), x.astype(float), q, 20) for q in range(n) if n > 1}


def test_a_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_ROWS", 200)
    rng = np.random.default_rng(6)
    x = np.eye(12)[0] + 0.001 * rng.standard_normal((1500, 12))  # all in a bucket or two
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set(_exact(list(range(1500)), x, q, 20))) for q in range(0, 1500, 20))
    assert hits >= 0.95 * 75 * 20, hits


def test_ids_that_come_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in A.nearest(table, table.where("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 0.5 * 0.9 + 0.1 * 0.1), (1, 2, 3, -0.5)]


def test_the_ann_query_returns_the_contract(spark, tmp_path):
    x = np.random.default_rng(9).standard_normal((400, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = A.op5_multiprobe_ann(spark, str(tmp_path))
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = found.collect()
    assert {r.query_id for r in rows} == set(range(0, 400, 20)) and len(rows) == 20 * 20
    assert all(r.score == float((x[r.query_id].astype(float) * x[r.vec_id].astype(float)).sum()) for r in rows)


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3))
    y = (rng.random(400) < sigmoid(x @ [1.0, -2.0, 0.0] + 0.5)).astype(float)
    none = np.zeros(0, np.int64)
    m = fit_logistic(none, none, 0, x, y, penalty=0.1, rounds=600)
    p = sigmoid(m.logit(none, none, x))
    assert abs((p - y).sum()) < 0.1 and abs(m.dense[0] / m.scale[0] - 1) < 0.4 and abs(m.dense[1] / m.scale[1] + 2) < 0.6
    one = fit_logistic(none, none, 0, x, np.ones(400))
    assert sigmoid(one.logit(none, none, x)).min() > 0.99
    assert len(TrainingSet(np.zeros(0, np.int32), np.zeros(0, np.uint64), 0).hashes) == 0


def corpus(words, n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad, poor = rng.random() < 0.2, rng.random() < 0.25
        own = rng.choices(words, k=rng.randint(20, 60))
        if bad:
            for _ in range(rng.randint(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(["vilefool", "nastyrat", "grimeboyish", "grimeboyed", "grimeboying"]))
        if poor:
            own = [w + rng.choice(["%%%", "***", " |"]) for w in own]
        rows.append((i, " ".join(own), f"s{i % 5}"))
        labels.append((i, int(not poor), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, words):
    rows, labels = corpus(words, 1500, 1)
    docs = make_docs(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] < 900] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    chain = X.train_toxicity(docs, known)
    assert chain.names == ["poor", "toxic"] and chain.models[1][1].dense.shape == (1,)
    got = {r.doc_id: r for r in X.score_toxicity(docs, chain).collect()}
    held = [x for x in labels if x[0] >= 900]
    caught = sum(got[i].rejected for i, _, t in held if t)
    wrong = sum(got[i].rejected for i, _, t in held if not t)
    assert caught >= 0.95 * sum(t for *_, t in held) and wrong <= 0.01 * len(held)
    one = X.train_toxicity(docs, known.drop("quality"))
    assert one.names == ["toxic"] and one.models[0][1].dense.shape == (0,)
    few = X.train_toxicity(docs, known, fit_bytes=2000)
    assert len(few.models[0][0].hashes) < len(chain.models[0][0].hashes)


def test_the_bar_comes_from_rows_no_part_of_the_chain_has_seen(spark, words):
    """Against a chain put together step by step, with dictionaries, on the same rows."""
    rows, labels = corpus(words, 240, 21)
    texts = {i: t for i, t, _ in rows}
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = X.train_toxicity(make_docs(spark, rows), known)
    place = {i: xxhash.xxh64(i.to_bytes(8, "little"), seed=xxhash.xxh64((9).to_bytes(4, "little"), seed=42).intdigest()).intdigest() for i in texts}
    ids = np.array(sorted(texts, key=lambda i: (np.uint64(place[i]).astype(np.int64), i)))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": [texts[i] for i in ids], "poor": [1 - labels[i][1] for i in ids], "toxic": [labels[i][2] for i in ids]})
    data, _, y = X._read(iter([batch]), ["poor", "toxic"], 1 << 30)
    p = np.zeros(len(ids))
    for k in range(X.FOLDS):
        out = X.outer_fold(ids) == k
        fit, earlier, inner = np.flatnonzero(~out), np.zeros((len(ids), 1)), X.folds(ids, X.FOLDS)
        first = X._fit_one(data, fit, y[:, 0], np.zeros((len(ids), 0)))
        for j in range(X.FOLDS):
            held = fit[inner[fit] == j]
            chosen, model = X._fit_one(data, fit[inner[fit] != j], y[:, 0], np.zeros((len(ids), 0)))
            earlier[held, 0] = model.logit(*data.pairs(held, chosen), np.zeros((len(held), 0)))
        second = X._fit_one(data, fit, y[:, 1], earlier)
        held = np.flatnonzero(out)
        z = first[1].logit(*data.pairs(held, first[0]), np.zeros((len(held), 0)))
        p[held] = sigmoid(second[1].logit(*data.pairs(held, second[0]), z[:, None]))
    assert abs(X.bar_of(p, y[:, 1], X.PRECISION) - chain.bar) < 1e-9


def test_toxicity_of_odd_rows(spark, words, odd_rows):
    rows, labels = corpus(words, 1500, 2)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = X.train_toxicity(make_docs(spark, rows), known)
    odd = make_docs(spark, odd_rows)
    out = X.score_toxicity(odd, chain, keep=odd.columns)
    assert out.count() == len(odd_rows) and not out.where("rejected").count()
    assert X.drop_toxic(odd, known.where("false")).columns == odd.columns
    assert X.drop_toxic(odd, known.where("false")).count() == len(odd_rows)
    assert X.score_toxicity(odd.where("false"), chain).count() == 0


def test_quality_on_held_out_rows(spark, words, odd_rows):
    rows, labels = corpus(words, 1500, 3)
    docs = make_docs(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    model, seen = Q.train_quality(docs, known)
    assert model.metadata == ["source", "lang", "n_chars"]
    got = {r.doc_id: r for r in Q.score_quality(docs, model).collect()}
    assert {r.doc_id: r for r in Q.score_described(seen, model).collect()} == got
    held = [x for x in labels if x[0] >= 400]
    kept = [got[i].keep for i, q, _ in held if q]
    poor = [got[i].keep for i, q, _ in held if not q]
    assert sum(kept) >= 0.97 * len(kept) and sum(poor) <= 0.1 * len(poor)
    assert all(0 <= r.quality_score <= 1 for r in got.values())
    odd = make_docs(spark, odd_rows)
    assert Q.score_quality(odd, model, keep=odd.columns).count() == len(odd_rows)
    assert Q.score_quality(odd.where("false"), model).count() == 0
    none, _ = Q.train_quality(docs, known.where("false"))
    assert Q.score_quality(docs, none).where("not keep").count() == 0


def test_the_setting_of_pages():
    import pyarrow as pa

    texts = ["", "One line. Ends?\nsecond\n\nThird!", "a | b | c", "|>" * 50, "\n", "Ü.\nB"]
    data, offsets = utf8(pa.array(texts))
    for t, got in zip(texts, Q.setting(data, offsets, 0, len(texts)).tolist(), strict=True):
        lines = t.split("\n")
        words = sum(t.count(c) for c in " \t\n") + 1
        begin, end = sum(x[:1] in set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") and x != "" for x in lines), sum(x[-1:] in set(".!?") and x != "" for x in lines)
        marks = math.ceil(8 * min(1, sum(t.count(c) for c in "|>") / words))
        assert got == [math.floor(2 * math.log2(len(lines))), math.floor(2 * math.log2(1 + len(t.encode()) / len(lines))), round(8 * begin / len(lines)), round(8 * end / len(lines)), marks], t


def test_cotraining_equals_its_steps_by_hand(spark, words):
    """Every round and the final models against plain loops over the same features, on a small table with copies."""
    rows, labels = corpus(words, 160, 31)
    rows = [(i, t, "poor" if not q and i % 2 else s) for (i, t, s), (_, q, _) in zip(rows, labels, strict=True)] + [(1000 + i, rows[150][1], rows[150][2]) for i in range(5)]
    docs = make_docs(spark, rows)
    known = spark.createDataFrame([x for x in labels if x[0] < 80], "doc_id long, quality int, toxic int")
    sure, growth = 0.7, 0.2
    model, seen = Q.train_quality(docs, known, rounds=2, growth=growth, sure=sure)
    table = pa.Table.from_pandas(seen.orderBy("row").toPandas())
    views = Q.features_of(table.combine_chunks().to_batches()[0])
    ids, digest = table.column("doc_id").to_numpy(), table.column("digest").to_numpy()
    truth = np.array([labels[i][1] if i < 80 else np.nan for i in ids.tolist()], float)
    sizes, own = Q._sizes(len(model.vocabulary.hashes)), [truth.copy(), truth.copy()]
    share = np.nanmean(truth)
    quota = [max(1, round(growth * 80 * x)) for x in (1 - share, share)]
    taken, added = [set(), set()], 0
    for _ in range(2):
        now = [o.copy() for o in own]
        for v in (0, 1):
            fit = np.flatnonzero(~np.isnan(own[v]))
            p = sigmoid(Q.logits(Q.fit_view(views[v], sizes[v], fit, own[v]), views[v]))
            fresh = set()
            for value in (0, 1):
                sureness = p if value else 1 - p
                met, left = set(), quota[value]
                for j in sorted(range(len(ids)), key=lambda j: (-sureness[j], digest[j], j)):
                    if np.isnan(truth[j]) and sureness[j] >= sure and digest[j] not in taken[1 - v] and digest[j] not in met and left:
                        met.add(digest[j])
                        left -= 1
                        if np.isnan(now[1 - v][j]):
                            now[1 - v][j] = value
                            added += 1
                fresh |= met
            taken[1 - v] |= fresh
        own = now
    assert added > 10 and sum(model.taught) == added and min(model.taught) > 0
    for v, view in enumerate((model.text, model.page)):
        rows_v = np.flatnonzero(~np.isnan(own[v]))
        assert np.allclose(Q.fit_view(views[v], sizes[v], rows_v, own[v]).sparse, view.model.sparse, atol=1e-7)
    got = {r.doc_id: r for r in Q.score_described(seen, model).collect()}
    for j, i in enumerate(ids.tolist()):
        z = [view.slope * view.model.logit(*(x[f == j] * 0 if k == 0 else x[f == j] if k == 1 else x[j : j + 1] for k, x in enumerate((f, g, d)))) + view.shift for view, (f, g, d) in zip((model.text, model.page), views, strict=True)]
        assert abs(got[i].p_content - sigmoid(z[0])[0]) < 1e-5 and abs(got[i].p_page - sigmoid(z[1])[0]) < 1e-5
