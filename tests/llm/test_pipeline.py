import os
import random
from collections import Counter

import pytest

import corpus_pipeline as C
from harrow.llm import queries
from harrow.llm.queries import QUERIES

from .conftest import make_docs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, at = docs, {}
    for name, stage in C.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = at[name] = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == first.columns
    ids = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in at.items() if n != "packing"}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert toxic <= set(ids["toxicity"])  # none of the clean labelled ones went
    assert set(ids["ngram_jaccard_join"]) <= set(ids["toxicity"]) and ids["secret_scan"] == ids["ngram_jaccard_join"]
    assert set(ids["source_mixing"]) == set(ids["secret_scan"]) and max(ids["source_mixing"].values()) <= 2
    texts = {r.doc_id: r.text for r in first.collect()}
    kept = [texts[i] for i in ids["ngram_jaccard_join"]]
    assert len(set(kept)) == len(kept)
    assert {r.doc_id for r in at["packing"].collect()} == set(ids["source_mixing"])
    assert C.run(spark, SF).count() == at["packing"].count()


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


COLUMNS = {
    "op2_source_mixing": {"doc_id": "bigint", "source": "string", "tokens": "bigint", "weight": "double", "epoch": "bigint", "block": "bigint", "block_key": "bigint", "doc_key": "bigint"},
    "op4_order_minhash": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op6_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_quality_cotraining": {"doc_id": "bigint", "p_content": "double", "p_page": "double", "quality_score": "double", "keep": "boolean"},
    "op9_toxicity_chain": {"doc_id": "bigint", "p_poor": "double", "p_toxic": "double", "toxic": "boolean"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_their_columns(spark, odd_rows, words, tmp_path, name):
    rng = random.Random(9)
    rows = odd_rows + [(100 + i, " ".join(rng.choices(words, k=20)), "abc"[i % 3]) for i in range(60)]
    make_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, i % 2, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES[name](spark, str(tmp_path))
    assert dict(found.dtypes) == COLUMNS[name]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in found.select("doc_id").collect())
    wanted = sorted((i is None, i or 0) for i, _, _ in rows)
    assert set(ids) == set(wanted) and (ids == wanted or name == "op2_source_mixing")
