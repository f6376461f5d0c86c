"""Toxicity by a classifier chain.

Categories are predicted in order; each later linear model also gets the earlier
categories' log odds. For training these come out of fold, so a later model sees the
errors that the earlier ones will make. Words, and the first 4, 5 and 6 bytes of
longer ones (for families of derived words), are the features.

The categories are the label table's own columns, ``toxic`` last. Where the table has
``quality`` too, ``poor`` (its opposite) comes first in the chain: of the labels that
there are, the only other one.

The bar comes from nested folds: for each outer fold a whole chain, with folds of its
own, is fitted on the other rows and judges the fold's, which no part of it has seen.

A document is scored by passages of ``PASSAGE`` words, all of them, and is as toxic as
its most toxic one: a long clean text holds a few words of every kind, but not at once.

The chain is fitted on at most ``FIT_ROWS`` labelled rows of each class and about
``FIT_BYTES`` of their texts, in the order of a hash of their ids; the outer folds and
the chain that stays are a task each. Every document is scored, whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import chain as chain_of

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, lean
from .linear import Logistic, TrainingSet, Vocabulary, distinct, document_features, fit_logistic, folds, passage_features, sigmoid
from .words import blocks, utf8

FIT_ROWS = 3000
FIT_BYTES = 1 << 25
FOLDS = 5
TERMS = 4096
PREFIXES = (4, 5, 6)
PASSAGE = 1000
PRECISION = 0.98
LEAST_BAR = 0.5


def _read(batches: Iterator[pa.RecordBatch], names: Sequence[str], fit_bytes: int) -> tuple[TrainingSet, np.ndarray, np.ndarray]:
    """Training rows up to ``fit_bytes`` of text: distinct (row, feature) pairs, ids, and labels (nan: unknown)."""
    docs, feats, ids, labels, n, size = [], [], [], [], 0, 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        kept = int(np.searchsorted(offsets - offsets[0], fit_bytes - size, "right")) - 1 if size < fit_bytes else 0
        kept = max(kept, 1 if not n and batch.num_rows else 0)
        for first, last in blocks(offsets[: kept + 1]):
            d, f = distinct(*document_features(data, offsets, first, last, PREFIXES))
            docs.append((d + n + first).astype(np.int32))
            feats.append(f)
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False)[:kept])
        labels.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)[:kept])
        n, size = n + kept, size + int(offsets[-1] - offsets[0])
    cat = lambda parts, none: np.concatenate(parts) if parts else none
    pairs = cat(docs, np.zeros(0, np.int32)), cat(feats, np.zeros(0, np.uint64))
    return TrainingSet(*pairs, n), cat(ids, np.zeros(0, np.int64)), cat(labels, np.zeros((0, len(names))))


class Chain:
    """Models of the categories in order, their vocabularies, and the bar of the last."""

    def __init__(self, names: Sequence[str], models: list[tuple[Vocabulary, Logistic]], bar: float):
        self.names, self.models, self.bar = list(names), models, bar

    def predict(self, docs: np.ndarray, feats: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities (rows, categories)."""
        earlier = np.zeros((rows, 0))
        for vocabulary, model in self.models:
            d, f = vocabulary.find(docs, feats)
            earlier = np.hstack((earlier, model.logit(d, f, earlier)[:, None]))
        return sigmoid(earlier)


def _fit_one(data: TrainingSet, rows: np.ndarray, label: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, Logistic]:
    """The features and the model of one category, from those of ``rows`` whose label is known."""
    rows = rows[~np.isnan(label[rows])]
    chosen = data.select(rows, label[rows], TERMS, only_positive=True)
    return chosen, fit_logistic(*data.pairs(rows, chosen), len(chosen), earlier[rows], label[rows])


def fit_models(data: TrainingSet, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, Logistic]]:
    """A chain fitted on ``rows``: the features and the model of each category."""
    fold, earlier, models = folds(ids, FOLDS), np.zeros((len(ids), 0)), []
    for label in labels.T:
        models.append(_fit_one(data, rows, label, earlier))
        out = np.zeros(len(ids))
        for k in range(FOLDS):
            held = rows[fold[rows] == k]
            if len(held):
                chosen, model = _fit_one(data, rows[fold[rows] != k], label, earlier)
                out[held] = model.logit(*data.pairs(held, chosen), earlier[held])
        earlier = np.hstack((earlier, out[:, None]))
    return models


def judge(data: TrainingSet, models: list[tuple[np.ndarray, Logistic]], rows: np.ndarray) -> np.ndarray:
    """The last category's probability of ``rows`` by a fitted chain."""
    earlier = np.zeros((len(rows), 0))
    for chosen, model in models:
        earlier = np.hstack((earlier, model.logit(*data.pairs(rows, chosen), earlier)[:, None]))
    return sigmoid(earlier[:, -1])


def outer_fold(ids: np.ndarray) -> np.ndarray:
    """Folds that have nothing to do with the inner ones."""
    return folds(ids ^ np.int64(0x5DEECE66D), FOLDS)


def bar_of(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest held-out probability above which ``precision`` of the rows are positive, and never below an even chance."""
    if not len(y) or not y.max() > 0:
        return 1.0
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precision) & (p[order] >= LEAST_BAR))
    if not len(good):
        return 1.0
    below = p[order[good[-1] + 1]] if good[-1] + 1 < len(y) else 0.0
    return float(max(LEAST_BAR, (p[order[good[-1]]] + below) / 2))


@lean
def _train(batches: Iterator[pa.RecordBatch], names: Sequence[str], fit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of one part: part ``FOLDS`` gives the chain, part ``k`` the judgement of fold ``k`` (probabilities and labels)."""
    first = next(batches, None)
    if first is None:
        return
    part = first.column("part")[0].as_py()
    data, ids, labels = _read(chain_of((first,), batches), names, fit_bytes)
    every = np.arange(len(ids))
    held = every[outer_fold(ids) == part]
    models = fit_models(data, ids, labels, every if part == FOLDS else every[outer_fold(ids) != part])
    made = p = y = None
    if part == FOLDS:
        made = pickle.dumps([(Vocabulary(data.hashes[chosen]), model) for chosen, model in models])
    else:
        p, y = judge(data, models, held).tobytes(), labels[held, -1].tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (made, p, y)], names=["models", "p", "y"])


def categories(labels: DataFrame) -> list[str]:
    """The chain's categories from a table's columns: ``poor`` where it has ``quality``, then ``toxic``."""
    return [*(["poor"] if "quality" in labels.columns else []), "toxic"]


def train_toxicity(docs: DataFrame, labels: DataFrame, columns: Sequence[str] | None = None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, precision: float = PRECISION) -> Chain:
    """Fit on (doc_id, text) joined with (doc_id, 0/1 columns), toxicity in the last column.

    ``columns``: the categories in order (default: ``categories(labels)``). At most
    ``fit_rows`` rows with and without the last label and ``fit_bytes`` of text, in the
    order of a hash of their ids, are used; rows with a null last label or id are not, a
    null in an earlier column only keeps the row out of that category. Of repeated ids
    one row is used. Without any labelled row the chain finds nothing toxic.
    """
    names = list(columns or categories(labels))
    source = labels.withColumn("poor", 1 - F.col("quality")) if "poor" in names and "poor" not in labels.columns else labels
    known = source.select("doc_id", *[F.col(c).cast("int").alias(c) for c in names]).dropna(subset=["doc_id", names[-1]])
    known = known.groupBy("doc_id").agg(F.max(F.struct(*reversed(names))).alias("l")).select("doc_id", *[F.col("l")[c].alias(c) for c in names])
    rows = first_by_hash(known, names[-1], fit_rows, 9)
    sample = F.broadcast(rows).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").dropDuplicates(["doc_id"])
    parts = sample.select("doc_id", "text", *names, F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("part"))
    dealt = parts.repartitionById(FOLDS + 1, "part").sortWithinPartitions(F.xxhash64(F.lit(9), "doc_id"), "doc_id")
    models, p, y = None, [], []
    for r in dealt.mapInArrow(partial(_train, names=names, fit_bytes=fit_bytes), "models binary, p binary, y binary").toLocalIterator():
        if r.models is not None:
            models = pickle.loads(r.models)
        else:
            p.append(np.frombuffer(r.p))
            y.append(np.frombuffer(r.y))
    if models is None:  # no rows, no task: the model of nothing
        data = TrainingSet(np.zeros(0, np.int32), np.zeros(0, np.uint64), 0)
        models = [(Vocabulary(data.hashes), m) for _, m in fit_models(data, np.zeros(0, np.int64), np.zeros((0, len(names))), np.zeros(0, np.int64))]
    return Chain(names, models, bar_of(np.concatenate(p), np.concatenate(y), precision) if p else 1.0)


def _worst(chain: Chain, units: np.ndarray, feats: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Probabilities of each document's passage with the largest last one."""
    p = chain.predict(units, feats, len(owner))
    order = np.lexsort((-p[:, -1], owner))
    return p[order[np.concatenate((np.ones(min(1, len(owner)), bool), owner[order][1:] != owner[order][:-1]))]]


@lean
def _score(batches: Iterator[pa.RecordBatch], chain: Chain, keep: list[str], text: str) -> Iterator[pa.RecordBatch]:
    names = [f"p_{c}" for c in chain.names]
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        parts = [_worst(chain, *passage_features(data, offsets, first, last, PASSAGE, PREFIXES)) for first, last in blocks(offsets)]
        p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(np.round(p[:, j], 6)) for j in range(len(names))], pa.array(p[:, -1] >= chain.bar)], names=[*keep, *names, "rejected"])


def score_toxicity(docs: DataFrame, chain: Chain, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, a probability ``p_<category>`` for each category, and ``rejected``.

    ``rejected``: the last category's probability reaches the chain's bar. Null or empty
    text has no feature and gets the constants. One row for each row, repeated ones too;
    columns of ``keep`` that clash with the result's names are left out. No rows give none.
    """
    names = [f"p_{c}" for c in chain.names]
    keep = [c for c in keep if c not in (*names, "rejected", "harrow_text")]
    text = "text" if "text" in keep else "harrow_text"
    rows = docs.select(*keep, *([] if text in keep else [F.col("text").alias(text)]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    schema = ", ".join([*([kinds] if kinds else []), *[f"{n} double" for n in names], "rejected boolean"])
    return rows.mapInArrow(partial(_score, chain=chain, keep=keep, text=text), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that a chain fitted on ``labels`` does not reject, columns as they were."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, **options), keep=docs.columns)
    return scored.where(~F.col("rejected")).select(*docs.columns)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the chain's probabilities and ``toxic`` (the rejected ones) for all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, chain).withColumnRenamed("rejected", "toxic")
