"""From raw documents to packed training sequences: five stages over the whole table.

1. toxicity: documents that the classifier chain rejects go.
2. n-gram Jaccard join: of each group of near duplicates the smallest id stays.
3. secret scan: secrets are replaced in the texts; every document stays.
4. source mixing: smaller sources repeat, up to one and a half times; every document
   stays at least once.
5. packing: token ids in windows, each filled to the sources' shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import staged_path
from harrow.llm.jaccard_join import drop_near_duplicates
from harrow.llm.mixing import mix_sources
from harrow.llm.packing import pack
from harrow.llm.secret_scan import redact, scan_secrets
from harrow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(scan_secrets(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Trained models and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = staged_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
