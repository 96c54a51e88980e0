"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, brown_lm, jaccard_join, kd_shards, line_rules, mixing, paragraphs, periodic, pii, token_files, topk_search, toxicity, whitening

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
WORD_FILE, END_ID = "word_bpe_49k.json", 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shards(_documents(spark, sf_dir), n_shards=24)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), bpe.read_ranks(public_tokenizers.path(RANK_FILE)), public_tokenizers.PATTERN)


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_documents(spark, sf_dir))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rules(_documents(spark, sf_dir))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scores(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.found(_documents(spark, sf_dir), periodic.rotated))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), token_files.read_file(public_tokenizers.path(WORD_FILE)), END_ID)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_topk_search, op2_kd_shards, op3_byte_bpe, op4_paragraph_dedup, op5_line_rules, op6_brown_lm, op7_toxicity, op8_mixing, op9_jaccard_join, op10_pii, op11_periodic_runs, op12_whitening, op13_token_files]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk_search.ORACLE, "op8_mixing": mixing.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE}
