"""Every registered query of the engine against its SQL twin."""

import os

import duckdb
import pytest

from harrow.operators import search
from harrow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    cursor = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=order) == sorted(wanted, key=order)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "bm25_topk" in e.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_choice_of_k_tries_the_whole_grid(spark):
    rows = registry.QUERIES["kmeans_select_k"](spark, SF).collect()
    assert sorted(r.k for r in rows) == [4, 6, 8, 10, 12, 16]
    assert [r.k for r in rows if r.chosen] == [max(rows, key=lambda r: r.silhouette).k]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["hybrid_minmax", "hybrid_mmr", "retrieve_default"])
def test_hybrid_lists_are_ranked_from_k_rows_a_query_and_task(spark, monkeypatch, name):
    handed, ranked = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda scores, *rest: handed.append(scores) or ranked(scores, *rest))
    registry.QUERIES[name](spark, SF)
    tasks, asked = registry.documents(spark, SF).rdd.getNumPartitions(), registry.items(spark, SF).count()
    *lists, fused = handed  # the dense list and the lexical one come first
    assert len(lists) == 2 and registry.documents(spark, SF).count() > tasks * registry.PREFETCH
    assert all(scores.count() <= asked * registry.PREFETCH * tasks for scores in lists)
    assert fused.count() <= asked * registry.PREFETCH * 2
