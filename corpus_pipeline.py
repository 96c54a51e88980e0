"""The corpus pipeline: quality rules, near-duplicate removal, redaction of
personal data, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, jaccard_join, line_rules, mixing, pii
from lodestone.llm.common import written
from lodestone.llm.queries import RANK_FILE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return line_rules.kept_documents(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, Jaccard similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the leaves' budgets take, each once at most."""
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of what they decode to."""
    return bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path(RANK_FILE)), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_dedup", jaccard_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: Near copies, bootstrapped patterns and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
