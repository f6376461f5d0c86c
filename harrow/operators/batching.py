"""Batches for an embedding service, and the pace of its requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RateLimitError
from ..options import EmbeddingOptions
from ..staging import stage


def greedy_batches(sizes: list[int], max_texts: int, max_tokens: int) -> list[int]:
    """The batch of each text, in order; a text over the token limit is a batch of its own."""
    out, batch, texts, tokens = [], 0, 0, 0
    for size in sizes:
        if texts and (texts == max_texts or tokens + size > max_tokens):
            batch, texts, tokens = batch + 1, 0, 0
        out.append(batch)
        texts, tokens = texts + 1, tokens + size
    return out


def next_starts(sizes: np.ndarray, max_texts: int, max_tokens: int) -> np.ndarray:
    """For each text the place of the text that begins the next batch, if it begins one itself."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(sizes))
    by_tokens = np.searchsorted(ends, ends[:-1] + max_tokens, "right") - 1
    return np.minimum(np.maximum(by_tokens, at + 1), at + max_texts)


def last_starts(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, batches closed) of each text, if it begins a batch: the last start that is reached from it, by pointer jumping."""
    n = len(follow)
    at, steps = np.where(follow < n, follow, np.arange(n)), (follow < n).astype(np.int64)
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at, steps
        steps, at = steps + steps[at], further


def _runs(groups: pa.Array | None, n: int) -> list[tuple[int, int]]:
    """Stretches of equal groups."""
    if groups is None or n == 0:
        return [(0, n)] if n else []
    codes = np.asarray(pc.fill_null(groups.dictionary_encode().indices, -1))
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:], strict=False))


def _whole(batches: Iterator[pa.RecordBatch], columns: list[str]) -> list[pa.Array]:
    """Some columns of a task's rows."""
    table = pa.Table.from_batches([b.select(columns) for b in batches])
    return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]


def pack_batches(texts: DataFrame, options: EmbeddingOptions | None = None, id_col: str = "doc_id", group: str | None = None) -> DataFrame:
    """(id, tokens[, group]) with ``batch``: greedy batches within the text and token limits, in order of id.

    With ``group`` batches are made within each group (one flush of an ingest, say). With
    a token rate set, a single text over it is refused. Where a batch begins depends on
    all texts before, yet no task sees them: a range of texts says where its last batch
    begins for each place at which the batch that is open before it may have begun (at
    most ``max_texts`` of them), and these answers are put one after the other.
    """
    options = options or EmbeddingOptions()
    most, budget = options.max_batch_texts, options.batch_tokens
    if options.tokens_per_minute is not None:
        shown = F.concat(F.lit("a text of "), F.col("tokens").cast("string"), F.lit(f" tokens exceeds the budget of {budget}"))
        largest = texts.agg(F.max("tokens")).first()[0]
        if largest is not None and largest > budget:
            raise RateLimitError(f"a text of {largest} tokens exceeds the budget of {budget}")
        texts = texts.where(F.when(F.col("tokens") > budget, F.raise_error(shown)).otherwise(F.lit(True)))
    spark, order = texts.sparkSession, [*([group] if group else []), id_col]
    ranged = texts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).persist()
    wanted = ["tokens", *([group] if group else [])]
    try:
        packed = stage(ranged.mapInArrow(_placed(wanted, most, budget, _opening(ranged, wanted, group, most, budget)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", batch bigint"))
    finally:
        ranged.unpersist()
    return packed


def _opening(ranged: DataFrame, wanted: list[str], group: str | None, most: int, budget: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each range the number of texts that the open batch before it holds, that batch's number, and these texts' sizes.

    What comes to the driver of a range are a few counts and at most ``max_texts`` sizes and answers.
    """
    kind = dict(ranged.dtypes)[group] if group else "int"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, *groups = _whole(batches, wanted)
        n = len(sizes)
        if n:
            own = groups[0] if groups else pa.array([0] * n, pa.int32())
            runs = _runs(groups[0] if groups else None, n)
            tail = sizes[max(runs[-1][0], n - most) :]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]).cast(pa.int32()), own[:1], own[n - 1 :], pa.array([len(runs) == 1]), pa.array([tail.to_pylist()], pa.list_(pa.int64()))], names=["part", "first", "last", "one", "tail"])

    seen = ranged.mapInArrow(ends, f"part int, first {kind}, last {kind}, one boolean, tail array<bigint>").orderBy("part").collect()
    before: dict[int, list[int]] = {}
    tail, open_group = [], None
    for k, r in enumerate(seen):
        before[r.part] = tail if k and r.first == open_group else []
        tail = ([*before[r.part], *r.tail] if r.one else list(r.tail))[-most:]
        open_group = r.last

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, *groups = _whole(batches, wanted)
        n, part = len(sizes), TaskContext.get().partitionId()
        if not n:
            return
        sizes, runs, held = sizes.to_numpy(), _runs(groups[0] if groups else None, n), before[part]
        own = np.concatenate((np.array(held, np.int64), sizes[: runs[0][1]]))
        at, closed = last_starts(next_starts(own, most, budget))
        starts = len(held) + 1
        left, done = len(own) - at[:starts], closed[:starts]
        if len(runs) > 1:  # the last group begins here, whatever came before
            at, closed = last_starts(next_starts(sizes[runs[-1][0] :], most, budget))
            left, done = np.full(starts, n - runs[-1][0] - at[0]), np.full(starts, closed[0])
        yield pa.RecordBatch.from_arrays([pa.array([part]).cast(pa.int32()), pa.array([len(runs) == 1]), pa.array([left.tolist()], pa.list_(pa.int64())), pa.array([done.tolist()], pa.list_(pa.int64()))], names=["part", "one", "held", "closed"])

    opening, held, number = {}, 0, 0
    for r in ranged.mapInArrow(answers, "part int, one boolean, held array<bigint>, closed array<bigint>").orderBy("part").collect():
        if not before[r.part]:
            held, number = 0, 0
        opening[r.part] = held, number
        at = len(before[r.part]) - held
        held, number = r.held[at], r.closed[at] + (number if r.one else 0)
    return {part: (h, number, before[part][len(before[part]) - h :]) for part, (h, number) in opening.items()}


def _placed(wanted: list[str], most: int, budget: int, opening: dict):
    """The task that numbers a range's batches, from what is open before it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        n = sum(b.num_rows for b in rows)
        if not n:
            return
        sizes, *groups = _whole(iter(rows), wanted)
        held, number, open_sizes = opening[TaskContext.get().partitionId()]
        out = np.zeros(n, np.int64)
        for k, (a, b) in enumerate(_runs(groups[0] if groups else None, n)):
            mine = sizes.to_numpy()[a:b]
            lead = held if k == 0 else 0
            if lead:
                mine = np.concatenate((np.array(open_sizes, np.int64), mine))
            follow, at = next_starts(mine, most, budget), 0
            begins = np.zeros(len(mine), np.int64)
            while at < len(mine):
                begins[at] = 1
                at = int(follow[at])
            out[a:b] = (np.cumsum(begins) - 1)[lead:] + (number if k == 0 else 0)
        at = 0
        for b in rows:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[at : at + b.num_rows])], names=[*b.schema.names, "batch"])
            at += b.num_rows

    return task


class RateLimiter:
    """When requests may go out: at most so many requests and tokens in any window, requests evenly spaced.

    ``wait(tokens, now)`` gives the seconds until the next may go and counts it as sent then.
    """

    def __init__(self, requests: int | None = None, tokens: int | None = None, window: float = 60.0):
        self.requests, self.tokens, self.window = requests, tokens, window
        self._sent: deque[tuple[float, int]] = deque()

    def wait(self, tokens: int, now: float) -> float:
        if self.tokens is not None and tokens > self.tokens:
            raise RateLimitError(f"a request of {tokens} tokens can never fit the budget of {self.tokens}")
        at = now
        if self._sent:
            at = max(at, self._sent[-1][0])
            if self.requests:
                at = max(at, self._sent[-1][0] + self.window / self.requests)
        while True:
            live = [(t, n) for t, n in self._sent if t + self.window > at]
            full = self.requests is not None and len(live) >= self.requests
            heavy = self.tokens is not None and sum(n for _, n in live) + tokens > self.tokens
            if not (full or heavy):
                break
            at = live[0][0] + self.window
        self._sent = deque((t, n) for t, n in self._sent if t + self.window > at)
        self._sent.append((at, tokens))
        return at - now


def schedule(requests: DataFrame, limiter: Callable[[], RateLimiter], order: str = "request_id", tokens: str = "tokens") -> DataFrame:
    """(request, tokens, at): when each request of one provider goes out, in order; one queue is one task by nature."""
    kind = {f.name: f.dataType.simpleString() for f in requests.schema}[order]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, now = limiter(), 0.0
        for frame in frames:
            times = []
            for n in frame[tokens]:
                now += pace.wait(int(n), now)
                times.append(now)
            yield pd.DataFrame({order: frame[order], "tokens": frame[tokens].astype("int64"), "at": pd.Series(times, index=frame.index, dtype="float64")})

    return requests.select(order, F.col(tokens).cast("bigint").alias(tokens)).repartition(1).sortWithinPartitions(order).mapInPandas(run, f"{order} {kind}, tokens bigint, at double")


def with_retries(call: Callable, transient: tuple[type[BaseException], ...], retries: int, sleep: Callable[[float], None], jitter: Callable[[], float]):
    """``call()`` again after a transient error, at most ``retries`` times, waiting up to 1, 2, 4 .. 60 seconds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except transient:
            if attempt == retries:
                raise
            sleep(min(60.0, 2.0**attempt) * jitter())
