"""Stored postings in blocks with their greatest impacts, and block-max search over them.

A folder holds two tables.  postings has one row for each term and block of
documents (a range of doc_id): term, block, n (documents), peak (the greatest
saturation of the term's frequency in the block, which times the term's idf
bounds its impact on any document there) and docs (doc_id, tf, dl), sorted by
term within its files, so a search reads the pages of its terms alone.  sizes
has one row: n_docs, avgdl, width (doc ids of a block).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import counted, tokens
from lodestone.operators.search import impact, impacts, inverse_frequency
from lodestone.operators.storage import if_small, stored, union, written

#: Part of an index's name: changes with the layout or the tokens.
VERSION = 3
#: Documents of a block, about.
BLOCK_DOCS = 128
#: Text of a partition while an index is built, about: its words are counted in memory.
PART_BYTES = 16 << 20
#: Blocks of a question scored in the first and by the end of the second round.
ROUNDS = (4, 64)


def build(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> None:
    """Index docs (doc_id, text).  Lengths and the range of ids come from one pass over the documents, postings from a second."""
    held = docs.where("text is not null").select("doc_id", "text")
    sizes = held.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.octet_length("text")).alias("bytes")).first()
    width = 1 << max(0, round(math.log2(block_docs * ((sizes.high or 0) - (sizes.low or 0) + 1) / max(1, sizes.n_docs))))
    row = docs.sparkSession.createDataFrame([(sizes.n_docs, sizes.avgdl or 0.0, width)], "n_docs long, avgdl double, width long")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    saturation = impact(F.lit(1.0), F.col("tf"), F.col("dl"), F.lit(float(sizes.avgdl or 1)))
    # texts go to their block's partition once; words and postings are counted and gathered there
    dealt = held.withColumn("block", F.floor(F.col("doc_id") / width)).repartition(1 + (sizes.bytes or 0) // PART_BYTES, "block")
    words = dealt.select("block", "doc_id", tokens(F.col("text")).alias("ws"))
    entries = words.select("block", "doc_id", F.size("ws").alias("dl"), F.inline(counted(F.col("ws"))))
    if not held.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows of one id are one document where they are equally long
        entries = entries.groupBy("block", "term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
    blocks = entries.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(saturation).alias("peak"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs"))
    blocks.sortWithinPartitions("term", "block").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")


def matches(spark: SparkSession, path: str, terms: tuple[str, ...]) -> DataFrame:
    """doc_id and score of every document with a term."""
    blocks = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(list(terms)))
    return impacts(blocks.select("term", F.inline("docs")), spark.read.parquet(f"{path}/sizes"))


def index_of(spark: SparkSession, source: str) -> str:
    """The folder of the index over the documents at source, built the first time it is asked for."""
    return stored(spark, source, f"postings-{VERSION}", lambda path: build(spark.read.parquet(source), path))


@dataclass
class Search:
    """top: question, rank, doc_id, score; bounds: question, block, upper for every block with a term of the question; read: question, block of those scored."""

    top: DataFrame
    bounds: DataFrame
    read: DataFrame


def block_max(spark: SparkSession, path: str, questions: DataFrame, k: int = 10) -> Search:
    """The k best documents of each question (question, term), exactly, ties by doc_id.

    The bounds of all blocks come from their peaks alone.  A question's most
    promising blocks are scored first; its k-th best score so far is the
    threshold below which a block is never read, and it rises from round to
    round.  All questions take part in the same joins, and every step is a
    table, so nothing of a question or a hot term gathers in one task.
    """
    asked = written(questions.where("term is not null").select("question", "term").distinct(), "asked")
    blocks, sizes = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes")
    terms = if_small(asked.select("term").distinct())
    met = blocks.select("term", "block", "n", "peak").join(terms, "term", "left_semi")
    idf = written(met.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(sizes)).withColumn("idf", inverse_frequency(F.col("n_docs"), F.col("df"))), "idf")
    weighed = asked.join(if_small(idf), "term")
    peaks = met.join(if_small(weighed.select("question", "term", "idf")), "term")
    upper = F.sum(F.ceil(100 * F.col("idf") * F.col("peak") + 1e-6)).alias("upper")
    bounds = written(peaks.groupBy("question", "block").agg(upper), "bounds")
    best_first = Window.partitionBy("question").orderBy(F.desc("upper"), "block")
    early = written(bounds.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= ROUNDS[1]), "early")

    def scored(chosen: DataFrame) -> DataFrame:
        """question, doc_id, score of the documents of the chosen blocks; a document lies in one block."""
        wanted = chosen.select("question", "block").join(if_small(weighed), "question")
        hits = blocks.select("term", "block", "docs").join(terms, "term", "left_semi").join(if_small(wanted), ["term", "block"])
        rows = hits.select("question", "idf", "avgdl", F.inline("docs"))
        return rows.groupBy("question", "doc_id").agg(F.sum(_points(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))

    order = Window.partitionBy("question").orderBy(F.desc("score"), "doc_id")
    ranks = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rounds, read = [], []
    last = early.groupBy("question").agg(F.max_by(F.struct("upper", "block"), "place").alias("last"))
    later = bounds.join(if_small(last), "question").where((F.col("upper") < F.col("last.upper")) | ((F.col("upper") == F.col("last.upper")) & (F.col("block") > F.col("last.block"))))
    for blocks_left in (early.where(F.col("place") <= ROUNDS[0]), early.where(F.col("place") > ROUNDS[0]), later):
        if rounds:
            threshold = ranks(union(rounds)).where(F.col("rank") == k).select("question", F.col("score").alias("least"))
            blocks_left = blocks_left.join(if_small(written(threshold, "threshold")), "question", "left").where(F.coalesce(F.col("upper") >= F.col("least"), F.lit(True)))
        chosen = written(blocks_left.select("question", "block"), "chosen")
        read.append(chosen)
        rounds.append(written(ranks(scored(chosen)).drop("rank"), "scored"))
    return Search(ranks(union(rounds)).select("question", "rank", "doc_id", "score"), bounds, union(read))


def _points(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return F.bround(impact(idf, tf, dl, avgdl) * 100).cast("long")
