"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes all that its predecessor kept, as a table with the columns of ``documents``;
the last returns token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainspark.llm.common import documents, durable
from chainspark.llm.decontaminate import drop_leaked
from chainspark.llm.exact_dedup import drop_copies
from chainspark.llm.jaccard_join import keep_one
from chainspark.llm.quality import keep_good
from chainspark.llm.sentencepiece_codec import default_model, digests, encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(encode_documents(docs, default_model()))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", tokens),
]

#: The classifier's decisions cannot be stated in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: dict[str, str] | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
