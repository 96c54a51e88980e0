"""Ranked retrieval: lexical, dense and bit lanes, fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import tokens


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, tf, dl."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("ws"))
    return words.select("doc_id", F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def impact(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """k1 and b are fixed values."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def impacts(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id and its integer score from postings (term, doc_id, tf, dl) and one row (n_docs, avgdl).

    Impacts are rounded half to even at two digits, so sums don't depend on
    their order.
    """
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hits.join(F.broadcast(df), "term").join(F.broadcast(sizes))
    own = impact(inverse_frequency(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return x.groupBy("doc_id").agg(F.sum(F.bround(own * 100).cast("long")).alias("score"))


def top(df: DataFrame, score: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The k best, ties by the tie column."""
    return df.orderBy(F.col(score).desc() if descending else F.col(score).asc(), F.col(tie)).limit(k)


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """A bounded lane with its 1-based ranks."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(tie))))


def fused(lanes: dict[str, tuple[DataFrame, float]], item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the weighted masses of all lanes, one union and one aggregation."""
    parts = [df.select(item, F.lit(1 << i).alias("lane"), (F.lit(float(w)) / (k + F.col("rank"))).alias("mass")) for i, (df, w) in enumerate(lanes.values())]
    return reduce(DataFrame.unionByName, parts).groupBy(item).agg(F.sum("mass").alias("score"), F.bit_or("lane").alias("lanes"))


def probe_distances(df: DataFrame, probes: DataFrame, distance: Column) -> DataFrame:
    """All rows against a few probes (a bounded side)."""
    return df.join(F.broadcast(probes)).withColumn("distance", distance)


def nearest(df: DataFrame, probe: str, k: int, tie: str, farthest: bool = False) -> DataFrame:
    """The k nearest rows of each probe."""
    order = F.col("distance").desc() if farthest else F.col("distance").asc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(probe).orderBy(order, F.col(tie)))).where(F.col("rank") <= k)


def cosine_top_k(vectors: DataFrame, probes: DataFrame, k: int, block: int = 256) -> DataFrame:
    """probe, vec_id, rank, cosine: the k nearest vectors of each probe (probe, q), probe itself included.

    Probes go out in blocks of bounded size; each task keeps the k best of
    each probe over all its rows, so k rows a probe and task are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    asked = probes.where("q is not null").toArrow()
    ids, q = np.asarray(asked.column("probe")), np.array(asked.column("q").to_pylist(), float)
    sent = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))) if len(ids) else None

    def run(batches):
        names, unit = sent.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            own = np.asarray(b.column(0))
            v = np.asarray(b.column(1).flatten().cast(pa.float64())).reshape(len(own), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for at in range(0, len(names), block):
                near = v @ unit[at : at + block].T
                for i in range(near.shape[1]):
                    score, item = np.concatenate((best[at + i][0], near[:, i])), np.concatenate((best[at + i][1], own))
                    if len(score) > k:
                        keep = np.flatnonzero(score >= np.partition(score, -k)[-k] - 1e-9)
                        score, item = score[keep], item[keep]
                    best[at + i] = (score, item)
        for name, (score, item) in zip(names, best, strict=True):
            if len(item):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), name)), pa.array(item), pa.array(score)], ["probe", "vec_id", "cosine"])

    schema = "probe long, vec_id long, cosine double"
    if sent is None:
        return spark.createDataFrame([], schema + ", rank int")
    found = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding is not null").mapInArrow(run, schema)
    order = Window.partitionBy("probe").orderBy(F.round("cosine", 9).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def diversified(pool: DataFrame, k: int, weight: float, item: str = "vec_id", vector: str = "embedding", relevance: str = "relevance") -> DataFrame:
    """Greedy maximal marginal relevance over a pool of at most 256 rows.

    The choice is one after another by nature; the pool is cut to its bound
    first, so what the one task holds doesn't grow.
    """
    import numpy as np
    import pandas as pd

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf[vector].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel, near, out = pdf[relevance].to_numpy(float), np.zeros(len(pdf)), []
        while len(out) < min(k, len(pdf)):
            gain = weight * rel - (1 - weight) * near
            gain[out] = -np.inf
            best = int(gain.argmax())
            near = np.maximum(near, v @ v[best]) if out else v @ v[best]
            out.append(best)
        return pd.DataFrame({item: pdf[item].iloc[out].to_numpy(), "position": np.arange(1, len(out) + 1)})

    bounded = pool.orderBy(F.col(relevance).desc(), item).limit(256)
    return bounded.withColumn("_pool", F.lit(0)).groupBy("_pool").applyInPandas(greedy, f"{item} long, position int")


def within_bits(df: DataFrame, probes: DataFrame, item: str, bits: str, size: int, most: int) -> DataFrame:
    """(probe, item, distance) of rows whose bits (size of them, in a long) differ from a probe's in at most `most` places; nulls match nothing.

    Exact without comparing all: of most + 1 runs of bits two such rows share
    one, and meet at the first run they share.  probes: probe, and the bits.
    """
    cuts = [size * i // (most + 1) for i in range(most + 2)]
    runs = lambda: F.array(*(F.struct(F.lit(i).alias("run"), F.shiftrightunsigned(F.col(bits), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))
    rows = df.where(F.col(bits).isNotNull()).select(item, F.col(bits).alias("_b"), runs().alias("_r")).select(item, "_b", "_r", F.inline("_r"))
    asked = probes.where(F.col(bits).isNotNull()).select("probe", F.col(bits).alias("_p"), runs().alias("_q")).select("probe", "_p", "_q", F.inline("_q"))
    met = rows.join(asked, ["run", "value"]).withColumn("distance", F.bit_count(F.col("_b").bitwiseXOR(F.col("_p"))))
    first = F.forall(F.zip_with("_r", "_q", lambda a, b: (a["run"] >= F.col("run")) | (a["value"] != b["value"])), lambda x: x)
    return met.where((F.col("distance") <= most) & first).select("probe", item, "distance")


def frontier(limit: int, asked: int | None = None) -> int:
    """Depth of the pool for a limit: four times it, between 64 and 256; an asked depth is held to the same bounds."""
    return min(max(limit * 4 if asked is None else asked, 64), 256)


def candidates(limit: int) -> int:
    """Candidates of each lane: four times the limit, 32 at least."""
    return max(limit * 4, 32)
