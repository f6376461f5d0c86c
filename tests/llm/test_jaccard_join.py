import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from harrow.llm import jaccard_join as J
from harrow.llm.graph import components

from .conftest import make_docs


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (shingles, component) by comparing all documents that share a shingle."""
    sets = [(i, shingles(t)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(k)
    shared = Counter((a, b) for own in lists.values() for j, b in enumerate(own) for a in own[:j])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), i if not s else least.get(find(k), i)) for k, (i, s) in enumerate(sets))


def near_copies(words, seed):
    rng, rows = random.Random(seed), []
    for base in range(12):
        text = rng.choices(words, k=rng.randint(4, 120))
        for _ in range(rng.choice([1, 1, 3, 12])):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(own).title() if rng.random() < 0.2 else " ".join(own), f"s{base % 3}"))
    passage = " ".join(rng.choices(words, k=80))
    rows += [(2000 + i, passage + " " + " ".join(rng.choices(words, k=8 + 2 * i)), "p") for i in range(15)]
    return rows


@pytest.mark.parametrize("cell", [1_500_000, 150])
def test_against_brute_force(spark, words, odd_rows, cell):
    for rows in (near_copies(words, 1) + odd_rows, near_copies(words, 2)):
        got = J.near_duplicate_components(make_docs(spark, rows), cell_shingles=cell).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_repeated_ids_and_links_through_rows_without_an_id(spark, words):
    rng = random.Random(5)
    a = rng.choices(words, k=60)
    b, c = [*a[:57], "x", "y", "z"], [*a[:54], "u", "v", "w", "x", "y", "z"]
    other = rng.choices(words, k=60)
    rows = [(1, " ".join(a), "s"), (None, " ".join(b), "s"), (3, " ".join(c), "s"), (3, " ".join(other), "s"), (4, " ".join([*other[:58], "q", "r"]), "s"), (None, " ".join(rng.choices(words, k=9)), "s")]
    got = J.near_duplicate_components(make_docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert {r.doc_id: r.component_id for r in got}[1] == 1 and [r.component_id for r in got if r.doc_id == 3] in ([1, 3], [3, 1])


def test_a_passage_that_all_documents_share(spark, words):
    """Ranked as rare (all sketch ranks alike), it chains everything; the exact counts take it apart again."""
    rng = random.Random(6)
    passage = rng.choices(words, k=30)
    rows = [(i, " ".join([*passage, *rng.choices(words, k=rng.randint(10, 60))]), "s") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end", "s") for i in range(0, 300, 10)]
    docs = make_docs(spark, rows)
    ranks = spark.sparkContext.broadcast(np.zeros(1 << J.SKETCH_BITS, np.uint8))
    schema = J.pa.schema([("key", J.pa.int64()), ("n", J.pa.int64()), ("sid", J.pa.int64()), ("low", J.pa.bool_()), ("other", J.pa.int64())])
    listed = docs.select("doc_id", "text").mapInArrow(J.partial(J._short_lists, width=5, percent=80, ranks=ranks, schema=schema), "key bigint, n bigint, sid bigint, low boolean, other bigint")
    blind = J._chain(listed.withColumn("key", J.F.coalesce("key", J.F.xxhash64("n", "sid", "other"))), 80)
    sets = docs.select(J.F.col("doc_id").alias("id"), "text").mapInArrow(J.partial(J._full_sets, width=5, schema=J.pa.schema([("id", J.pa.int64()), ("n", J.pa.int64()), ("sid", J.pa.int64()), ("items", J.pa.binary())])), "id bigint, n bigint, sid bigint, items binary")
    exact = J.exact_chain(sets.withColumn("group", J.F.lit(1).cast("bigint")), 80)
    assert exact.count() < 60 < blind.count()
    got = J.near_duplicate_components(docs, cell_shingles=2000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_merged_runs():
    rng = np.random.default_rng(4)
    for sizes in ([], [3], [1, 5, 2], [200, 3, 90, 1, 1, 400]):
        runs = [np.sort(rng.integers(0, 50, n)).astype(np.int32) for n in sizes]
        assert J.merged_runs(runs).tolist() == sorted(x for r in runs for x in r.tolist())


def test_a_task_sends_one_posting_for_sets_of_one_size():
    keys, n, low = np.array([7, 7, 7, 7, 8, 8, 9, 9]), np.array([5, 5, 5, 6, 5, 5, 5, 5]), np.array([0, 1, 1, 1, 0, 0, 1, 1], bool)
    sid = np.array([1, 3, 2, 9, 4, 5, 2, 3])
    sent, links = J._chained_here(keys, n, sid, low)
    assert sorted(sent.tolist()) == [2, 3, 4, 5, 6]
    assert {tuple(x) for x in np.stack(links, axis=1).tolist()} == {(5, 2, 1), (5, 2, 3)}


def test_exact_threshold(spark):
    # 8 of 10 shingles shared: 100 * 8 = 80 * 10; one less is no link.
    base = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(base), "a"), (2, " ".join(base[:12]), "a"), (3, " ".join([*base[:12], "q"]), "a"), (4, " ".join(["z", *base[1:12], "q"]), "a")]
    got = J.near_duplicate_components(make_docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_local_search_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pool = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        sets = sorted((np.unique(rng.choice(pool, rng.integers(1, 40))) for _ in range(25)), key=len)
        forest = J.t_occurrence_links(sets, np.full(25, 2, np.int8))
        root = list(range(25))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                n = len(np.intersect1d(a, sets[j]))
                if 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                    root[find(i)] = find(j)
        mine = list(range(25))
        for a, b in forest:
            mine[find(b, mine)] = find(a, mine)
        assert len({(find(i), find(i, mine)) for i in range(25)}) == len({find(i) for i in range(25)}) == len({find(i, mine) for i in range(25)})


def test_empty_table_and_filter(spark, words):
    empty = make_docs(spark, [(1, "x", "s")]).where("false")
    assert J.near_duplicate_components(empty).count() == 0
    text = " ".join(words[:50])
    docs = make_docs(spark, [(3, text, "s"), (2, text, "s"), (9, "other words", "s"), (None, text, "s")])
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 9]


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
