"""Document quality by co-training two views.

The content view sees what is written: words, runs of symbols, shares of kinds of
characters. The page view sees no words. It has the table's other columns (source,
language and length; numbers count by quarter octaves) and how the page is set: how
many lines there are and how long, how many of them begin and end like sentences, how
dense navigation marks are. Each view starts from the labelled rows. In every round
each scores all unlabelled documents and labels the ones it is surest of, in the
classes' known proportion; they join the *other* view's training rows. Of equal
documents one is taken. At the end both are calibrated on out-of-fold log odds of the
labelled rows (Platt), and a last model on both log odds scores every document.

Texts are read once: a document becomes a list of known terms (at most ``TERMS``, the
commonest of the labelled rows, whatever their labels), its layout and its page
features. That table is written, and the rounds run over it. Fitting takes at most
``FIT_ROWS`` labelled rows of each class (``FIT_BYTES`` of text for the terms), in the
order of a hash of their ids, and the pseudo-labelled ones, a share ``GROWTH`` of these
a round; labelled rows beyond that count as unlabelled. A task fits one model, of one
view or of one fold of it. Every document is a candidate in every round, and is scored,
whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, lean, staged
from .linear import Logistic, Vocabulary, distinct, document_features, fit_logistic, folds, sigmoid
from .tokens import binary_column
from .words import blocks, mix, utf8

FIT_ROWS = 3000
FIT_BYTES = 1 << 26
ROUNDS = 4
SURE = 0.95
GROWTH = 0.1
FOLDS = 4
TERMS = 1 << 15
LEAST_DOCS = 3
PAGE_BITS = 16
LAYOUT = 6
METADATA = ("source", "lang", "n_chars")
KEEP_GOOD = 0.998
_U = np.uint64
_LETTER, _DIGIT, _SYMBOL, _UPPER, _SPACE, _LINE, _STOP, _MARK = (
    np.array([f(chr(c), c) for c in range(256)])
    for f in (lambda s, c: c >= 128 or s.isalpha(), lambda s, c: c < 128 and s.isdigit(), lambda s, c: 33 <= c < 127 and not s.isalnum(), lambda s, c: c < 128 and s.isupper(), lambda s, c: s in " \t", lambda s, c: s == "\n", lambda s, c: s in ".!?", lambda s, c: s in "|>")
)


def layout(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """Look of each document's words, whatever its length: log mean word, shares of characters, symbols next to each other."""
    lo, hi = int(offsets[first]), int(offsets[last])
    own, raw = offsets[first : last + 1] - lo, data[lo:hi]
    size = np.diff(own)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[own[1:]] - total[own[:-1]]

    symbol = _SYMBOL[raw]
    twice = np.concatenate((symbol[1:] & symbol[:-1], [False])) if len(raw) else symbol
    lines, spaces = count(_LINE[raw]) + 1, count(_SPACE[raw]) + 1
    n = np.maximum(size, 1)
    shares = [count(_LETTER[raw]) / n, count(_DIGIT[raw]) / n, count(symbol) / n, count(_UPPER[raw]) / n, count(twice) / n]
    return np.stack((np.log1p(size / (spaces + lines)), *shares), axis=1)


def setting(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """How each page is set, in small integers: lines and their mean length by half octaves, eighths of lines that begin
    with a capital and that end a sentence, navigation marks to a word (up to one) by eighths."""
    lo, hi = int(offsets[first]), int(offsets[last])
    own, raw = offsets[first : last + 1] - lo, data[lo:hi]
    size, filled = np.diff(own), own[1:] > own[:-1]
    begins, ends = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    begins[1:], ends[:-1] = _LINE[raw[:-1]], _LINE[raw[1:]]
    begins[own[:-1][filled]], ends[own[1:][filled] - 1] = True, True

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[own[1:]] - total[own[:-1]]

    lines, words = count(_LINE[raw]) + 1, count(_SPACE[raw] | _LINE[raw]) + 1
    marks = np.ceil(8 * np.minimum(count(_MARK[raw]) / words, 1))
    return np.stack((np.floor(2 * np.log2(lines)), np.floor(2 * np.log2(1 + size / lines)), np.round(8 * count(begins & _UPPER[raw]) / lines), np.round(8 * count(ends & _STOP[raw]) / lines), marks), axis=1).astype(np.int64)


def page_features(columns: Sequence[Sequence]) -> np.ndarray:
    """(rows, columns): a hashed feature for each value; null is a value."""
    out = []
    for j, values in enumerate(columns):
        seen = {v: hash_text(f"{j}\x00{v!r}") for v in set(values)}
        out.append(mix(np.array([seen[v] for v in values], np.uint64)) >> _U(64 - PAGE_BITS))
    return np.stack(out, axis=1).astype(np.int64) if out else np.zeros((0, 0), np.int64)


def hash_text(s: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in s.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & ((1 << 64) - 1)
    return h


def page_column(df: DataFrame, name: str):
    """A metadata column as text: numbers by quarter octaves, what is no plain value as JSON."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(F.log2(1 + F.abs(F.col(name).cast("double"))) * 4).cast("string")
    return F.to_json(F.struct(F.col(name))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.col(name).cast("string")


@lean
def _common_terms(batches: Iterator[pa.RecordBatch], terms: int, fit_bytes: int) -> Iterator[pa.RecordBatch]:
    """The features that most rows have, ``LEAST_DOCS`` at least; rows come in the order of a hash."""
    feats, size = [], 0
    for batch in batches:
        data, offsets = utf8(batch.column("harrow_text"))
        for first, last in blocks(offsets):
            if size < fit_bytes:
                feats.append(distinct(*document_features(data, offsets, first, last, symbols=True))[1])
                size += int(offsets[last] - offsets[first])
    hashes, count = np.unique(np.concatenate(feats) if feats else np.zeros(0, np.uint64), return_counts=True)
    order = np.lexsort((hashes, -count))[:terms]
    yield pa.RecordBatch.from_arrays([pa.array([np.sort(hashes[order[count[order] >= LEAST_DOCS]]).tobytes()], pa.binary())], names=["terms"])


@lean
def _describe(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, metadata: list[str], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("harrow_text"))
        terms, counts, shape, page_set = [], [], [], [np.zeros((0, 5), np.int64)]
        for first, last in blocks(offsets):
            d, f = vocabulary.find(*document_features(data, offsets, first, last, symbols=True))
            terms.append(f.astype(np.uint16))
            counts.append(np.bincount(d, minlength=last - first))
            shape.append(layout(data, offsets, first, last).astype(np.float32))
            page_set.append(setting(data, offsets, first, last))
        n = batch.num_rows
        if not n:
            continue
        page = page_features([*np.concatenate(page_set).T.tolist(), *(batch.column(c).to_pylist() for c in metadata)]).astype(np.uint16)
        made = [binary_column(np.concatenate(terms), np.concatenate(counts)), binary_column(np.concatenate(shape).ravel(), np.full(n, LAYOUT)), binary_column(page.ravel(), np.full(n, page.shape[1]))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "harrow_terms", "harrow_layout", "harrow_page"])


def described(docs: DataFrame, vocabulary: Vocabulary, metadata: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and each document as both views see it: harrow_terms, harrow_layout, harrow_page."""
    keep = list(keep)
    rows = docs.select(*keep, *[page_column(docs, c).alias(f"harrow_{c}") for c in metadata], F.coalesce("text", F.lit("")).alias("harrow_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.mapInArrow(partial(_describe, vocabulary=vocabulary, metadata=[f"harrow_{c}" for c in metadata], keep=keep), f"{kinds}harrow_terms binary, harrow_layout binary, harrow_page binary")


Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def features_of(batch: pa.RecordBatch) -> tuple[Features, Features]:
    """(row, feature, dense columns) of the content view and of the page view."""
    n = batch.num_rows
    terms = [np.frombuffer(b, np.uint16) for b in batch.column("harrow_terms").to_pylist()]
    shape = np.frombuffer(b"".join(batch.column("harrow_layout").to_pylist()), np.float32).reshape(n, LAYOUT).astype(float)
    page = np.frombuffer(b"".join(batch.column("harrow_page").to_pylist()), np.uint16).reshape(n, -1)
    every = np.arange(n)
    content = np.repeat(every, [len(t) for t in terms]), (np.concatenate(terms) if n else np.zeros(0)).astype(np.int64), shape
    return content, (np.repeat(every, page.shape[1]), page.ravel().astype(np.int64), np.zeros((n, 0)))


def rows_of(view: Features, rows: np.ndarray) -> Features:
    place = np.full(len(view[2]), -1)
    place[rows] = np.arange(len(rows))
    own = place[view[0]]
    return own[own >= 0], view[1][own >= 0], view[2][rows]


def fit_view(view: Features, size: int, rows: np.ndarray, label: np.ndarray) -> Logistic:
    docs, feats, dense = rows_of(view, rows)
    return fit_logistic(docs, feats, size, dense, label[rows])


def logits(model: Logistic, view: Features) -> np.ndarray:
    return model.logit(*view)


@dataclass
class View:
    model: Logistic
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, view: Features) -> np.ndarray:
        return self.slope * logits(self.model, view) + self.shift


@dataclass
class CoTrained:
    vocabulary: Vocabulary
    text: View
    page: View
    both: Logistic
    bar: float
    metadata: list[str]
    #: Pseudo-labels that the content view and the page view gave to the other.
    taught: tuple[int, int] = (0, 0)

    def predict(self, content: Features, page: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality: content view, page view, both."""
        z = np.stack((self.text.logit(content), self.page.logit(page)), axis=1)
        none = np.zeros(0, np.int64)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(self.both.logit(none, none, z))


def _sizes(vocabulary_size: int) -> tuple[int, int]:
    return max(1, vocabulary_size), 1 << PAGE_BITS


def _labels(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def _fit_task(key: tuple, table: pa.Table, sizes: tuple[int, int]) -> pa.Table:
    """One model of a bounded table of training rows: of view ``task // (FOLDS + 1)``, without fold ``task % (FOLDS + 1) - 1`` of the labelled ones.

    ``content_label`` and ``page_label`` are what each view is trained on. Gives the model
    pickled, or for a fold the held-out rows with their log odds.
    """
    task = key[0].as_py()
    v, k = task // (FOLDS + 1), task % (FOLDS + 1) - 1
    table = table.sort_by("row").combine_chunks()
    view = features_of(table.to_batches()[0])[v]
    own, truth = _labels(table, ("content_label", "page_label")[v]), _labels(table, "quality")
    held = ~np.isnan(truth) & (folds(table.column("doc_id").to_numpy().astype(np.int64), FOLDS) == k) if k >= 0 else np.zeros(len(own), bool)
    made = fit_view(view, sizes[v], np.flatnonzero(~np.isnan(own) & ~held), own)
    if k >= 0:
        at = np.flatnonzero(held)
        made = table.column("row").to_numpy()[at], truth[at], logits(made, rows_of(view, at))
    return pa.table({"task": pa.array([task], pa.int32()), "made": pa.array([pickle.dumps(made)], pa.binary())})


def _fitted(training: DataFrame, tasks: Sequence[int], sizes: tuple[int, int]) -> dict[int, object]:
    """What ``_fit_task`` makes for each task, all at once; nothing without training rows. The training rows are sent once a task."""
    rows = training.withColumn("harrow_task", F.explode(F.array(*map(F.lit, tasks)))).repartitionByRange(len(tasks), "harrow_task")
    task = lambda key, table: _fit_task(key, table.drop_columns(["harrow_task"]), sizes)
    return {r.task: pickle.loads(r.made) for r in rows.groupBy("harrow_task").applyInArrow(task, "task int, made binary").collect()}


def _empty_view(v: int, size: int) -> Logistic:
    none = np.zeros(0, np.int64)
    return fit_logistic(none, none, size, np.zeros((0, LAYOUT if v == 0 else 0)), np.zeros(0))


def surest(p: np.ndarray, taken: np.ndarray, digest: np.ndarray, quota: int, sure: float) -> np.ndarray:
    """Positions of the ``quota`` largest ``p`` that reach ``sure``, one of each digest, ties to the smaller digest; ``taken`` are out."""
    at = np.flatnonzero((p >= sure) & ~taken)
    at = at[np.lexsort((digest[at], -p[at]))]
    _, first = np.unique(digest[at], return_index=True)
    return at[np.sort(first)][:quota]


@lean
def _pick(batches: Iterator[pa.RecordBatch], models: list[Logistic], taken: tuple[np.ndarray, np.ndarray], quota: tuple[int, int], sure: float) -> Iterator[pa.RecordBatch]:
    """(view, value, p, row, digest): what this task's unlabelled rows offer, at most a quota for each view and value."""
    best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    for batch in batches:
        row, digest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "digest"))
        for v, view in enumerate(features_of(batch)):
            good = sigmoid(logits(models[v], view))
            for value in (0, 1):
                own = good if value else 1 - good
                at = surest(own, np.isin(digest, taken[1 - v]), digest, quota[value], sure)
                held = best.get((v, value), (own[:0], row[:0], digest[:0]))
                p, r, d = (np.concatenate((x, y)) for x, y in zip(held, (own[at], row[at], digest[at]), strict=True))
                at = surest(p, np.zeros(len(p), bool), d, quota[value], sure)
                best[v, value] = p[at], r[at], d[at]
    for (v, value), (p, r, d) in best.items():
        n = len(p)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, value, np.int32)), pa.array(p), pa.array(r), pa.array(d)], names=["view", "value", "p", "row", "digest"])


def _finished(training: DataFrame, sizes: tuple[int, int], metadata: list[str], keep_good: float) -> CoTrained:
    """The last models of both views, their calibration on held-out folds of the labelled rows, and the model of both.

    The held-out log odds, two for each of a bounded number of labelled rows, come to the driver.
    """
    made, none = _fitted(training, range(2 * (FOLDS + 1)), sizes), np.zeros(0, np.int64)
    final, sides = [View(made.get(v * (FOLDS + 1)) or _empty_view(v, sizes[v])) for v in (0, 1)], []
    for v in (0, 1):
        parts = [made[t] for t in range(v * (FOLDS + 1) + 1, (v + 1) * (FOLDS + 1)) if t in made]
        rows, truth, z = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts, strict=True) if parts else [()] * 3))
        order = np.argsort(rows)
        truth, z = truth[order], z[order]
        platt = fit_logistic(none, none, 0, z[:, None], truth, penalty=0.01)
        final[v].slope = float(platt.dense[0] / platt.scale[0]) if len(z) else 1.0
        final[v].shift = float(platt.constant - final[v].slope * platt.centre[0])
        sides.append(final[v].slope * z + final[v].shift)
    z = np.stack(sides, axis=1)
    both = fit_logistic(none, none, 0, z, truth, penalty=0.01)
    return CoTrained(Vocabulary(np.zeros(0, np.uint64)), final[0], final[1], both, _bar(sigmoid(both.logit(none, none, z)), truth, keep_good), metadata)


def _bar(p: np.ndarray, y: np.ndarray, keep_good: float) -> float:
    """The bar with the best F1 for poor rows, among those that keep ``keep_good`` of the good ones (out of fold)."""
    good = np.sort(p[y == 1])
    if not len(good) or len(good) == len(p):
        return 0.0
    most = good[int((1 - keep_good) * len(good))]
    order = np.argsort(p, kind="stable")
    poor = np.cumsum(1 - y[order])
    f1 = 2 * poor / (np.arange(1, len(p) + 1) + poor[-1])
    f1[p[order] >= most] = -1
    best = int(np.argmax(f1))
    if f1[best] < 0:
        return 0.0
    return float((p[order[best]] + (p[order[best + 1]] if best + 1 < len(p) else 1.0)) / 2)


def train_quality(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] | None = None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, rounds: int = ROUNDS, growth: float = GROWTH, sure: float = SURE, keep_good: float = KEEP_GOOD) -> tuple[CoTrained, DataFrame]:
    """(model, the documents as its views see them): co-train on ``docs`` (doc_id, text, metadata...) and labels (doc_id, quality 0/1).

    ``metadata``: the page view's columns besides the setting (default: those of ``METADATA`` that there are).
    Null labels and ids are left out, of repeated ids one row is used. Without labels, or
    with one class only, every document scores that class's share and is kept.
    """
    metadata = [c for c in METADATA if c in docs.columns] if metadata is None else list(metadata)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = F.broadcast(staged(first_by_hash(known, "quality", fit_rows, 7), "quality-labels"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("harrow_text")).join(some.select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    ordered = texts.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    found = ordered.mapInArrow(partial(_common_terms, terms=TERMS, fit_bytes=fit_bytes), "terms binary").collect()
    vocabulary = Vocabulary(np.frombuffer(found[0].terms if found else b"", np.uint64))
    sizes = _sizes(len(vocabulary.hashes))

    rows = described(docs, vocabulary, metadata, ["doc_id"]).withColumns({"row": F.monotonically_increasing_id(), "digest": F.xxhash64("harrow_terms", "harrow_layout", "harrow_page")})
    seen = staged(rows, "quality-views")
    marked = seen.join(some, "doc_id", "left")
    labelled = staged(marked.where("quality is not null").dropDuplicates(["doc_id"]), "quality-labelled")
    counts = {r.quality: r["count"] for r in labelled.groupBy("quality").count().collect()}
    n, open_rows = sum(counts.values()), marked.where("quality is null").drop("quality")
    quota = tuple(max(1, round(growth * n * counts.get(value, 0) / n)) if n else 0 for value in (0, 1))
    pseudo: tuple[dict[int, int], dict[int, int]] = {}, {}
    digests: tuple[set[int], set[int]] = set(), set()
    spark = docs.sparkSession

    def training() -> DataFrame:
        marks = [(row, *(pseudo[v].get(row) for v in (0, 1))) for row in sorted({*pseudo[0], *pseudo[1]})]
        added = open_rows.join(F.broadcast(spark.createDataFrame(marks, "row bigint, content_label int, page_label int")), "row").withColumn("quality", F.lit(None).cast("int"))
        return labelled.withColumns({"content_label": F.col("quality"), "page_label": F.col("quality")}).unionByName(added)

    for _ in range(rounds if len(counts) == 2 else 0):
        found = _fitted(training(), (0, FOLDS + 1), sizes)
        models = [found[0], found[FOLDS + 1]]
        taken = tuple(np.array(sorted(d), np.int64) for d in digests)
        offers = open_rows.mapInArrow(partial(_pick, models=models, taken=taken, quota=quota, sure=sure), "view int, value int, p double, row bigint, digest bigint")
        best = Window.partitionBy("view", "value").orderBy(F.desc("p"), "digest", "row")
        single = offers.groupBy("view", "value", "digest").agg(F.max("p").alias("p"), F.min("row").alias("row"))
        # The plain bound lets each task leave out what can't be among a group's first.
        placed = single.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(quota))
        chosen = placed.where(F.when(F.col("value") == 1, F.lit(quota[1])).otherwise(F.lit(quota[0])) >= F.col("place"))
        for r in chosen.orderBy("view", "value", "place").collect():
            pseudo[1 - r.view].setdefault(r.row, r.value)
            digests[1 - r.view].add(r.digest)
    model = _finished(training(), sizes, metadata, keep_good)
    model.vocabulary, model.taught = vocabulary, (len(pseudo[1]), len(pseudo[0]))
    return model, seen


_RESULT = ("p_content", "p_page", "quality_score", "keep")


@lean
def _score(batches: Iterator[pa.RecordBatch], model: CoTrained, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            p = model.predict(*features_of(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(np.round(x, 6)) for x in p], pa.array(p[2] >= model.bar)], names=[*keep, *_RESULT])


def score_described(rows: DataFrame, model: CoTrained, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``score_quality`` of documents that ``described`` or ``train_quality`` has read already."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.select(*keep, "harrow_terms", "harrow_layout", "harrow_page").mapInArrow(partial(_score, model=model, keep=list(keep)), f"{kinds}p_content double, p_page double, quality_score double, keep boolean")


def score_quality(docs: DataFrame, model: CoTrained, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the views' calibrated probabilities ``p_content`` and ``p_page``,
    ``quality_score`` of both, and ``keep`` (the score reaches the model's bar).

    Null or empty text is judged by its other columns and its (empty) layout. One row for
    each row, repeated ones too; columns of ``keep`` that clash with the result's names
    are left out. No rows give none.
    """
    keep = [c for c in keep if c not in _RESULT and not c.startswith("harrow_")]
    return score_described(described(docs, model.vocabulary, model.metadata, keep), model, keep)


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, both views' probabilities, quality_score and keep for all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, seen = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_described(seen, model)
