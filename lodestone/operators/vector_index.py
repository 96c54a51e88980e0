"""A stored index for nearest neighbours by cosine: vectors in lists around coarse centroids.

A folder holds the centroids, how many lists a search looks into, and a
generation: segments of blocks (list, seq, block, ids, data: unit vectors as
little-endian floats, BLOCK_ROWS at most) and tombstones.  insert() writes a
further segment, remove() tombstones that name the block of each dead vector,
and compact() writes all that lives into a new generation.  Every write is a
Spark job into a folder of its own that counts once it is complete.

Centroids and the number of lists looked into are fitted on samples of a
stated size; every vector is indexed, and a search of all lists is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.storage import if_small, written

#: Vectors that the centroids are fitted on, and lists at most (their product bounds the driver's work).
SAMPLE, LISTS = 16_384, 1_024
#: Vectors that ask when the number of lists is chosen, and the recall aimed at.
ASKED, RECALL = 128, 0.95
#: Vectors of a block; neighbours that recall is measured by.
BLOCK_ROWS, NEAREST = 1_024, 10
#: Asking vectors, once for each list they look into, that may be broadcast.
ASKED_BYTES = 4 << 20
_BLOCKS = "list int, n int, ids array<long>, data binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length; a vector of zeros stays."""
    v = np.asarray(column.flatten().cast(pa.float32())).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors without a null or non-finite entry."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", entry)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(good)


def centroids(sample: np.ndarray, lists: int, sweeps: int = 12) -> np.ndarray:
    """Spherical k-means of a bounded sample, seeded by rows at even distances."""
    at = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(sweeps):
        own = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        held = np.bincount(own, minlength=lists) > 0
        at[held] = sums[held]
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-30)
    return at


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str

    # --- what is stored ---

    @classmethod
    def create(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Index vectors (vec_id, embedding) under path."""
        spark, rows = vectors.sparkSession, usable(vectors)
        n = rows.count()
        lists = lists or max(1, min(LISTS, int(n**0.5)))
        share = min(1.0, 2 * SAMPLE / max(1, n))
        sample = rows.sample(share, 1).limit(SAMPLE).toArrow() if n else None
        own = cls(spark, path)
        if sample is None or not sample.num_rows:
            own._save([], 1)
            return own
        fitted = centroids(_matrix(sample.column("embedding").combine_chunks()), min(lists, sample.num_rows))
        own._save(fitted.tolist(), len(fitted))
        own.insert(rows)
        own._save(fitted.tolist(), own._fewest(rows, n))
        return own

    def _save(self, points: list[list[float]], probes: int) -> None:
        rows = self.spark.createDataFrame([(i, p, probes) for i, p in enumerate(points)], "list int, centroid array<double>, probes int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    def lists(self) -> tuple[np.ndarray, int]:
        """Centroids (LISTS at most) and how many lists a search looks into."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r.centroid for r in rows] or np.zeros((0, 1)), np.float32), rows[0].probes if rows else 1

    def _folders(self, kind: str) -> dict[int, str]:
        """Complete folders of a kind in the current generation by their number; kind generation: the generations."""
        path_of, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        top = path_of(self.path if kind == "generation" else self._generation())
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return {}
        names = [f.getPath() for f in fs.listStatus(top)]
        return {int(m[1]): str(p) for p in names if (m := re.fullmatch(rf"{kind}=(\d+)", p.getName())) and (fs.exists(path_of(p, "_SUCCESS")) or (kind == "generation" and fs.exists(path_of(p, "segment=0/_SUCCESS"))))}

    def _generation(self) -> str:
        held = self._folders("generation")
        return held[max(held)] if held else f"{self.path}/generation=0"

    def _next(self) -> int:
        return max([-1, *self._folders("segment"), *self._folders("tombstones")]) + 1

    def _assigned(self, rows: DataFrame) -> DataFrame:
        """Blocks of rows by list.  Partitions are rebalanced, so a list of many vectors is split."""
        sent = self.spark.sparkContext.broadcast(self.lists()[0])

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array((_matrix(b.column(1)) @ sent.value.T).argmax(axis=1).astype(np.int32)), b.column(0), b.column(1)], ["list", "vec_id", "embedding"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, ids, data = [], [], []
            for b in batches:
                if not b.num_rows:
                    continue
                own, names, unit = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2))
                cuts = np.flatnonzero(np.diff(own)) + 1
                for s, e in zip([0, *cuts], [*cuts, len(own)], strict=True):
                    for at in range(s, e, BLOCK_ROWS):
                        lists.append(int(own[at]))
                        ids.append(names[at : min(e, at + BLOCK_ROWS)])
                        data.append(unit[at : min(e, at + BLOCK_ROWS)].astype("<f4").tobytes())
                if len(lists) >= 64:
                    yield _blocks(lists, ids, data)
                    lists, ids, data = [], [], []
            if lists:
                yield _blocks(lists, ids, data)

        named = rows.mapInArrow(nearest, "list int, vec_id long, embedding array<float>")
        return named.hint("rebalance", F.col("list")).sortWithinPartitions("list", "vec_id").mapInArrow(blocks, _BLOCKS).withColumn("block", F.monotonically_increasing_id())

    def insert(self, vectors: DataFrame, replace: bool = False) -> None:
        """Add vectors; replace: rows that the index has under their ids die first."""
        rows = usable(vectors)
        if replace:
            self.remove(rows.select("vec_id"))
        seq = self._next()
        self._assigned(rows).withColumn("seq", F.lit(seq)).write.parquet(f"{self._generation()}/segment={seq}")

    def remove(self, ids: DataFrame) -> None:
        """Tombstones for every row of the index under ids (vec_id)."""
        places = self._segments().select("seq", "block", F.explode("ids").alias("vec_id"))
        gone = places.join(if_small(written(ids.select("vec_id").distinct(), "gone")), "vec_id", "left_semi")
        gone.write.parquet(f"{self._generation()}/tombstones={self._next()}")

    def compact(self) -> None:
        """All that lives becomes the one segment of a new generation; readers of the old one are not disturbed."""
        held = self._folders("generation")
        self._assigned(self.rows()).withColumn("seq", F.lit(0)).write.parquet(f"{self.path}/generation={max([0, *held]) + 1}/segment=0")

    def _segments(self) -> DataFrame:
        found = [self.spark.read.parquet(p) for p in self._folders("segment").values()]
        if not found:
            return self.spark.createDataFrame([], _BLOCKS + ", block long, seq int")
        return found[0] if len(found) == 1 else self.spark.read.parquet(*self._folders("segment").values())

    def living(self) -> DataFrame:
        """Blocks with the ids that died in them (dead, a block's rows at most)."""
        stones = list(self._folders("tombstones").values())
        if not stones:
            return self._segments().withColumn("dead", F.lit(None).cast("array<long>"))
        dead = self.spark.read.parquet(*stones).groupBy("seq", "block").agg(F.collect_set("vec_id").alias("dead"))
        return self._segments().join(dead, ["seq", "block"], "left")

    def rows(self) -> DataFrame:
        """vec_id, embedding (of unit length) of all that lives."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, unit in _alive(b):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(unit), pa.list_(pa.float32()))], ["vec_id", "embedding"])

        return self.living().select("ids", "data", "dead").mapInArrow(run, "vec_id long, embedding array<float>")

    # --- search ---

    def search(self, queries: DataFrame, k: int = NEAREST, probes: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, cosine: the k nearest vectors of each query (vec_id, embedding) but its own id.

        probes: lists looked into; as many as there are: exact.  Queries travel
        in blocks to the blocks of their lists, where the k best of each are kept.
        """
        points, usual = self.lists()
        count = min(probes or usual, max(1, len(points)))
        sent = self.spark.sparkContext.broadcast(points)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(sent.value):
                    continue
                near = np.argpartition(-(_matrix(b.column(1)) @ sent.value.T), count - 1, axis=1)[:, :count]
                row = np.repeat(np.arange(b.num_rows), count)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["list", "vec_id", "embedding"])

        def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    order = np.argsort(np.asarray(b.column(0)), kind="stable")
                    own, ids, unit = np.asarray(b.column(0))[order], np.asarray(b.column(1))[order], _matrix(b.column(2))[order]
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    parts = list(zip([0, *cuts], [*cuts, len(own)], strict=True))
                    yield _blocks([int(own[s]) for s, _ in parts], [ids[s:e] for s, e in parts], [unit[s:e].astype("<f4").tobytes() for s, e in parts])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                asked = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
                for (ids, unit), (names, data) in zip(_alive(b), asked, strict=True):
                    near = np.round((np.frombuffer(data, "<f4").reshape(len(names), -1) @ unit.T).astype(float), 6)
                    near[np.array(names)[:, None] == ids[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :k]
                    score = np.take_along_axis(near, order, axis=1)
                    good = score.ravel() > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, order.shape[1])[good]), pa.array(ids[order].ravel()[good]), pa.array(score.ravel()[good])], ["query_id", "vec_id", "cosine"])

        asked = usable(queries).mapInArrow(spread, "list int, vec_id long, embedding array<float>")
        asked = written(asked.repartition("list").sortWithinPartitions("list").mapInArrow(grouped, _BLOCKS).select("list", F.col("ids").alias("names"), F.col("data").alias("asked")), "asked")
        few = (asked.agg(F.sum(F.octet_length("asked"))).first()[0] or 0) <= ASKED_BYTES
        met = self.living().select("list", "ids", "data", "dead").join(F.broadcast(asked) if few else asked.hint("merge"), "list")
        found = met.select("ids", "data", "dead", "names", "asked").mapInArrow(best, "query_id long, vec_id long, cosine double")
        order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")

    def recall(self, queries: DataFrame, k: int = NEAREST, probes: int | None = None, exact: DataFrame | None = None) -> float:
        """The share of the true k nearest that a search finds."""
        exact = exact or self.search(queries, k, max(1, len(self.lists()[0])))
        got = self.search(queries, k, probes).select("query_id", "vec_id").withColumn("hit", F.lit(1))
        n, hits = exact.join(got, ["query_id", "vec_id"], "left").agg(F.count(F.lit(1)), F.sum("hit")).first()
        return (hits or 0) / n if n else 1.0

    def _fewest(self, rows: DataFrame, n: int) -> int:
        """The fewest lists, by halving, that reach RECALL for some ASKED vectors."""
        asked = written(rows.sample(min(1.0, 2 * ASKED / max(1, n)), 2).limit(ASKED), "asked")
        low, high = 0, len(self.lists()[0])
        exact = written(self.search(asked, probes=high), "exact")
        while high - low > max(1, high // 6):
            middle = (low + high) // 2
            low, high = (low, middle) if self.recall(asked, probes=middle, exact=exact) >= RECALL else (middle, high)
        return high


def _blocks(lists: list[int], ids: list[np.ndarray], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array([len(i) for i in ids], pa.int32()), pa.array([i.tolist() for i in ids], pa.list_(pa.int64())), pa.array(data, pa.binary())], ["list", "n", "ids", "data"])


def _alive(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of each row (ids, data, dead), the dead left out."""
    for ids, data, dead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
        names, unit = np.array(ids, np.int64), np.frombuffer(data, "<f4").reshape(len(ids), -1)
        keep = ~np.isin(names, dead) if dead else slice(None)
        yield names[keep], unit[keep]
