"""Exact top-k inner product search over norm buckets.

Vectors are dealt over tasks by falling length (ties by id, so copies of one
vector spread), and each task cuts its share into small buckets of similar
length.  A query meets the buckets from the longest down with the k-th best
product that the task knows so far, theta.  For a bucket of greatest length l, theta / (|q| l)
is the cosine that a vector of the bucket needs at least, the local threshold:

* above 1 the bucket, and all shorter ones, are skipped (length pruning);
* if high, coordinate pruning: a unit vector with that cosine to the query has
  its coordinates within a band around the query's, and only vectors inside
  the band of the query's largest coordinates are candidates;
* otherwise each vector's own length is held against theta / |q|.

What is left is verified by exact integer products.  theta starts at a lower
bound from the longest vectors of the whole table, a set of fixed size.

Queries travel in blocks of BLOCK rows, so what a task holds is bounded
however many queries there are.

Defined results: vectors that are null or hold a null, NaN or infinite
component take no part, neither as query nor as candidate; vectors of
different dimension are no candidates for each other; a query with fewer than
k candidates returns all of them; equal products go to the smaller vec_id;
an empty vector has product 0 with every other empty one; rows that repeat an
id are candidates of their own, but never of a query of that id, and queries
of their own, each with its k results; products
beyond 64 bits are held at the nearest 64-bit value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.common import union, written

#: Queries sent out at once (at 1,000 dimensions 16 MB).
BLOCK = 2048
#: Longest vectors that give the first thresholds.
SEEDS = 2048
#: Vectors of one bucket.
BUCKET = 1024
#: Local cosine from which coordinates prune better than lengths, and coordinates looked at.
FOCUS_COSINE, FOCUS = 0.5, 3

_OUT = T.StructType([T.StructField("uid", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of integers) for each dimension, components floor(1024 x).

    Kept as doubles, which hold such integers exactly.
    """
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = np.asarray(column.flatten().cast(pa.float64()))
    begin = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    out = []
    for d in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, np.floor(1024.0 * flat[begin[rows][:, None] + np.arange(d)])))
    return out


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products v . q: by doubles where no sum can pass 2**53."""
    bound = np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(1, v.shape[1])
    if bound < 2.0**53:
        return (v @ q).astype(np.int64)
    whole = [[int(x) for x in row] for row in v]
    query = [int(x) for x in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(row, query, strict=True)))) for row in whole], np.int64)


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
        order = np.lexsort((i, ~s))[: self.k]
        self.score, self.ids = s[order], i[order]

    @property
    def theta(self) -> float:
        own = float(self.score[-1]) if len(self.score) == self.k else -np.inf
        return max(own, self.floor)


def _search(ids: np.ndarray, v: np.ndarray, queries: list[tuple[int, np.ndarray, float]], held: list[_Best]) -> None:
    """Take a share of the vectors into the best of each query."""
    norms = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((ids, -norms))
    ids, v, norms = ids[order], v[order], norms[order]
    unit = v / np.maximum(norms, 1e-300)[:, None]
    for (query_id, q, _), best in zip(queries, held, strict=True):
        length = float(np.sqrt((q * q).sum()))
        focus = np.argsort(-np.abs(q))[:FOCUS]
        for at in range(0, len(ids), BUCKET):
            s = slice(at, at + BUCKET)
            theta = best.theta
            # a little slack keeps rounding of the bounds from losing a tie
            need = theta / max(length * norms[at], 1e-300) - 1e-9 if np.isfinite(theta) and length > 0 else -np.inf
            if need > 1:
                break
            live = np.ones(len(ids[s]), bool)
            if need > FOCUS_COSINE:
                for f in focus:  # coordinates that a unit vector within that angle can have
                    c = q[f] / length
                    spread = np.sqrt(max(0.0, (1 - need * need) * (1 - c * c))) + 1e-9
                    if c >= -need:
                        live &= unit[s, f] >= need * c - spread
                    if c <= need:
                        live &= unit[s, f] <= need * c + spread
            elif np.isfinite(theta) and theta > 0 and length > 0:
                live &= norms[s] >= theta / length * (1 - 1e-9)
            live &= ids[s] != query_id
            if live.any():
                got = np.flatnonzero(live) + at
                best.add(_products(v[got], q), ids[got])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) without what takes no part."""
    v = F.col("v")
    bad: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all other vectors for
    every vector whose id is divisible by every."""
    ready = usable(vectors, id_col, vector_col)
    whole = F.transform("v", lambda x: F.floor(x * 1024.0).cast("double"))
    norm = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x))
    stored = written(ready.withColumn("norm", norm).withColumn("is_query", F.col("vec_id") % every == 0), "vectors")
    # ranges of length; the id breaks ties so that copies of a vector spread
    n = max(1, min(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored.count() // (4 * BUCKET) + 1))
    dealt = written(stored.repartitionByRange(n, F.col("norm").desc(), "vec_id").select("vec_id", "v"), "norm-ranges")
    seeds = stored.orderBy(F.col("norm").desc(), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    asked = stored.where("is_query").select("vec_id", "v")
    blocks = asked.count() // BLOCK + 1
    asked = written(asked.withColumn("uid", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")
    found = union([_block(dealt, seeds, asked.where(F.col("block") == b).select("vec_id", "v", "uid").toArrow(), k) for b in range(blocks)])
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _block(dealt: DataFrame, seeds: pa.Table, asked: pa.Table, k: int) -> DataFrame:
    """The best k of each task for one block of queries."""
    queries: dict[int, list[tuple[int, np.ndarray, float]]] = {}
    rows_of: dict[int, list[int]] = {}
    ids, uids = np.asarray(asked.column("vec_id")), np.asarray(asked.column("uid"))
    first = {m.shape[1]: (np.asarray(seeds.column("vec_id"))[rows], m) for rows, m in _matrix(seeds.column("v").combine_chunks())} if len(seeds) else {}
    for rows, m in _matrix(asked.column("v").combine_chunks()) if len(asked) else []:
        d = m.shape[1]
        for r, q in zip(rows, m, strict=True):
            floor = -np.inf
            if d in first:
                own = first[d][0] != ids[r]
                if own.sum() >= k:
                    floor = float(np.partition(_products(first[d][1][own], q), -k)[-k])
            queries.setdefault(d, []).append((int(ids[r]), q, floor))
            rows_of.setdefault(d, []).append(int(uids[r]))
    sent = dealt.sparkSession.sparkContext.broadcast((queries, rows_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one result a query over the whole task, so thresholds only rise and k rows a query leave it
        held: dict[int, list[_Best]] = {}
        for b in batches:
            for rows, m in _matrix(b.column(1)) if b.num_rows else []:
                asked_ = sent.value[0].get(m.shape[1], [])
                _search(np.asarray(b.column(0))[rows], m, asked_, held.setdefault(m.shape[1], [_Best(k, floor) for _, _, floor in asked_]))
        for d, bests in held.items():
            for (query_id, _, _), uid, best in zip(sent.value[0].get(d, []), sent.value[1].get(d, []), bests, strict=True):
                if n := len(best.ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, uid)), pa.array(np.full(n, query_id)), pa.array(best.ids), pa.array(best.score)], ["uid", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, _OUT)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
