"""Evaluation sets: questions about sampled passages and about pairs of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GenerationError
from ..operators.synthesis import multihop_pairs, sample_passages

#: Makes one question for each passage it gets; two passages make a question that needs both.
QuestionGenerator = Callable[[Sequence[Sequence[str]]], list[str]]


def first_sentence(passages: Sequence[Sequence[str]]) -> list[str]:
    """The offline generator: asks for the start of each passage."""
    return ["What is said about: " + " / ".join(p[:80].split("\n")[0] for p in group) + "?" for group in passages]


def _ask(frames: Iterator[pd.DataFrame], generator: QuestionGenerator) -> Iterator[pd.DataFrame]:
    for frame in frames:
        questions = generator([list(p) for p in frame["passage"]])
        if len(questions) != len(frame):
            raise GenerationError(f"{len(questions)} questions for {len(frame)} passages")
        yield frame.assign(query=questions)


def build_eval_set(docs: DataFrame, generator: QuestionGenerator, per_document: int = 2, pairs_per_topic: int = 5, seed: int = 13) -> DataFrame:
    """query_id, query, relevant_doc_ids, source, topic, passage, of (doc_id, title, text, source_uri, metadata).

    Mirrors never give rise to a question. A pair's source is ``multihop`` and its
    passages are the first sampled one of each document.
    """
    own = docs.where(F.col("metadata")["duplicate_of"].isNull()).select("doc_id", "text", F.col("metadata")["source"].alias("source"), F.col("metadata")["topic"].alias("topic"))
    picked = sample_passages(own, per_document, seed).join(own.drop("text"), "doc_id")
    single = picked.select(F.concat_ws("#", "doc_id", "line").alias("query_id"), F.array("doc_id").alias("relevant_doc_ids"), "source", "topic", F.array("passage").alias("passage"))
    one = picked.groupBy("doc_id").agg(F.min_by("passage", "line").alias("passage"), F.first("topic").alias("topic"))
    pairs = multihop_pairs(one.select("doc_id", "topic"), pairs_per_topic, seed)
    a, b = one.select(F.col("doc_id").alias("first"), F.col("passage").alias("pa")), one.select(F.col("doc_id").alias("second"), F.col("passage").alias("pb"))
    double = pairs.join(a, "first").join(b, "second").select(F.concat_ws("+", "first", "second").alias("query_id"), F.array("first", "second").alias("relevant_doc_ids"), F.lit("multihop").alias("source"), "topic", F.array("pa", "pb").alias("passage"))
    schema = "query_id string, relevant_doc_ids array<string>, source string, topic string, passage array<string>, query string"
    asked = single.unionByName(double).mapInPandas(partial(_ask, generator=generator), schema)
    return asked.select("query_id", "query", "relevant_doc_ids", "source", "topic", "passage")
