"""Changes that arrive late, twice, in any order, and over restarts give the index of one run."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException

from harrow.errors import EmbeddingError, IndexError_
from harrow.operators.store import IndexStore
from harrow.streaming.changes import apply_changes, ingest_changes
from harrow.streaming.ingest import HashedEmbedder, ingest


def change(i, sequence, text, deleted=False):
    return {"doc_id": f"d{i}", "title": f"t{i}", "text": text, "source_uri": "u", "metadata": {"n": str(i)}, "sequence": sequence, "deleted": deleted}


def changes(seed=1):
    rng = random.Random(seed)
    return [change(i, s, None if gone else f"text {rng.choice('abc')} of {i} at {s // 2}", gone) for i in range(8) for s in range(5) for gone in [rng.random() < 0.15]]


def contents(store):
    return sorted((r.doc_id, r.text, r.content_hash) for r in store.read("chunks").select("doc_id", "text", "content_hash").collect())


def last_of(rows):
    last = {}
    for r in rows:
        if r["doc_id"] not in last or r["sequence"] > last[r["doc_id"]]["sequence"]:
            last[r["doc_id"]] = r
    return sorted((d, r["text"]) for d, r in last.items() if not r["deleted"])


def test_any_order_gives_the_last_changes(spark, tmp_path):
    rows, rng = changes(), random.Random(1)
    mixed = rows + rng.choices(rows, k=15)  # some twice
    rng.shuffle(mixed)
    store, folder = IndexStore(spark, str(tmp_path / "index"), 16, buckets=2), tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in mixed[part::3]) + '{"doc_id": null, "sequence": 1}\n{"doc_id": "x"}\n')
        ingest_changes(spark, store, str(folder), str(tmp_path / "ck"), files_per_batch=1).awaitTermination()  # a restart each
    assert [c[:2] for c in contents(store)] == last_of(rows)
    version = store.manifest().version
    (folder / "again.jsonl").write_text("".join(json.dumps(r) + "\n" for r in mixed))
    ingest_changes(spark, store, str(folder), str(tmp_path / "ck")).awaitTermination()
    assert [c[:2] for c in contents(store)] == last_of(rows) and store.manifest().version <= version + 1  # no more than the mark of the batch
    whole = IndexStore(spark, str(tmp_path / "whole"), 16, buckets=2)
    ingest(whole, spark.createDataFrame([(f"d{i}", f"t{i}", t, "u", {"n": str(i)}) for d, t in last_of(rows) for i in [d[1:]]], "doc_id string, title string, text string, source_uri string, metadata map<string,string>"))
    assert contents(whole) == contents(store)


class Fails:
    """An embedder that is out of order until it is mended."""

    broken = True

    def documents(self, texts, id_col):
        if Fails.broken:
            raise EmbeddingError("no vectors today")
        return HashedEmbedder(16).documents(texts, id_col)

    queries = documents


def test_a_batch_that_broke_off_is_taken_up_again(spark, tmp_path):
    store, folder, seen = IndexStore(spark, str(tmp_path / "index"), 16, buckets=2), tmp_path / "in", []
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join(json.dumps(change(i, 1, f"text {i}")) for i in range(3)) + "\n" + json.dumps(change(9, 1, "")))
    query = ingest_changes(spark, store, str(folder), str(tmp_path / "ck"), seen.append, embed=Fails())
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    assert contents(store) == [] and seen[-1].broken == 4
    Fails.broken = False
    ingest_changes(spark, store, str(folder), str(tmp_path / "ck"), seen.append, embed=Fails()).awaitTermination()
    assert len(contents(store)) == 3 and seen[-1].failures == {"d9": "no text to index"} and seen[-1].broken == 0


def test_a_batch_is_applied_once(spark, tmp_path):
    from harrow.streaming.changes import CHANGE_SCHEMA

    store = IndexStore(spark, str(tmp_path / "index"), 16, buckets=2)
    rows = lambda *c: spark.createDataFrame([tuple(x.values()) for x in c], CHANGE_SCHEMA)
    assert apply_changes(store, rows(change(1, 1, "one"), change(2, 1, "two")), ("s", 0)).indexed == 2
    assert apply_changes(store, rows(change(1, 1, "other")), ("s", 0)).seen == 0
    assert apply_changes(store, rows(change(1, 2, None, True), change(2, 2, "two more")), ("s", 1)).indexed == 1
    assert [c[:2] for c in contents(store)] == [("d2", "two more")] and store.batch_done("s") == 1
    with pytest.raises(IndexError_):
        IndexStore(spark, str(tmp_path / "nowhere"), 16).batch_done("s")
