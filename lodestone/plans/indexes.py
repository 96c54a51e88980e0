"""Queries over stored indexes: block-max postings and vector lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as sc
from lodestone.operators import index
from lodestone.operators.storage import stored
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans.catalog import _TOK
from lodestone.plans.registry import ORACLES, QUERIES

_POINTS = "CAST(sum(round_even(100 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)), 0)) AS BIGINT)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of benchmark asks with all of its words."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question"), F.explode(sc.tokens(F.col("text"))).alias("term"))


def t07_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all questions at once."""
    return index.block_max(spark, index.index_of(spark, f"{sf_dir}/documents.parquet"), _questions(spark, sf_dir)).top


QUERIES["t07_block_max"] = t07_block_max
ORACLES["t07_block_max"] = f"""WITH d AS (SELECT doc_id, {_TOK} AS ws FROM documents), z AS (SELECT count(ws) AS n, avg(len(ws)) AS a FROM d),
q AS (SELECT DISTINCT item_id AS question, unnest({_TOK}) AS term FROM benchmark),
p AS (SELECT doc_id, len(ws) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT question, doc_id, {_POINTS} AS score FROM q JOIN p USING (term) JOIN dfs USING (term), z GROUP BY 1, 2)
SELECT question, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


# --- vectors --------------------------------------------------------------------------------------------------------------

_COSINES = """e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS l FROM embeddings),
c AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) / e.l / q.l AS cosine FROM e, e q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)"""


def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """The stored index over embeddings, and the vectors that ask: every id divisible by 100."""
    source = f"{sf_dir}/embeddings.parquet"
    table = spark.read.parquet(source)
    return VectorIndex(spark, stored(spark, source, "vectors-1", lambda path: VectorIndex.create(table, path))), table.where("vec_id % 100 = 0")


def z07_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact way: all lists of the stored index.  The cosine of the last rank is given, as near ties may part by the last digit of a float."""
    index, asked = vectors_of(spark, sf_dir)
    found = index.search(asked, probes=max(1, len(index.lists()[0])))
    return found.where("rank = 1").select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))


QUERIES["z07_all_lists"] = z07_all_lists
ORACLES["z07_all_lists"] = f"WITH {_COSINES} SELECT query_id, vec_id, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, vec_id) AS rank FROM c) WHERE rank = 1"


def z07_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search: ten neighbours of each asking vector, from the lists that reach the recall aimed at."""
    index, asked = vectors_of(spark, sf_dir)
    return index.search(asked)


QUERIES["z07_nearest"] = z07_nearest


def z07_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds nine tenths of the true neighbours."""
    index, asked = vectors_of(spark, sf_dir)
    exact = index.search(asked, probes=max(1, len(index.lists()[0]))).select("query_id", "vec_id")
    got = index.search(asked).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    counts = exact.join(got, ["query_id", "vec_id"], "left").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("hit").alias("hits"))
    return counts.select("neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("found"))


QUERIES["z07_recall"] = z07_recall
ORACLES["z07_recall"] = "SELECT 10 * count(*) AS neighbours, true AS found FROM embeddings WHERE vec_id % 100 = 0"
