"""A training-data pipeline over ``documents``, a stage an operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of its input, but for the last, which writes the token store and returns its
index. ``run`` writes every stage's rows to the shared folder and goes on from
what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkglass.llm import decontaminate, minhash, mixing, quality, token_store
from inkglass.session import scratch_dir, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 over 5-word shingles join."""
    return minhash.keep_one(docs, n=5, per_cent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to their weights."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's index: doc_id, start, n_tokens, ids_crc32."""
    return token_store.token_store(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-id output", token_output),
]

#: The classifiers and the tokenizer have no SQL. `test_pipeline_against_plain_stages` holds near-dedup and the token counts against brute force, the
#: quality and decontamination stages against their operators' own scores, and of mixing only that it keeps rows it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), where, f"stage{k}")
    return docs
