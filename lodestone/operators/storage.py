"""Durable intermediate tables, size-checked broadcasts and connected components on DataFrames."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a long key alone may be broadcast; such a row
#: costs under 64 bytes in the hash relation, so the bound is 13 MB; building
#: it takes the driver several times that.
BROADCAST_ROWS = 200_000

#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_stored: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Only a session on one machine, as in tests, gets a folder of its own if that is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def release() -> None:
    """Delete the intermediate tables of this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the process's other tables."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(spark: SparkSession, source: str, name: str, build: Callable[[str], object]) -> str:
    """A folder that build(path) made of the table at source, made the first time it is asked for.

    It lies in the shared folder under name (which says what and in which
    layout) and a hash of the source's files, their sizes and times, so a
    changed source gets a new one.  A builder works in a folder of its own and
    renames it; of two that work at once the first one's stays.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder, conf = path_of(source), spark._jsc.hadoopConfiguration()
    found = folder.getFileSystem(conf).listStatus(folder)
    state = "|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in found))
    path = f"{shared_dir(spark)}/lodestone-{name}-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    if path not in _stored:
        fs = path_of(path).getFileSystem(conf)
        if not fs.exists(path_of(path)):
            own = f"{shared_dir(spark)}/lodestone-building-{uuid.uuid4().hex}"
            build(own)
            if fs.exists(path_of(path)) or not fs.rename(path_of(own), path_of(path)):
                fs.delete(path_of(own), True)
        _stored.add(path)
    return path


def discard(*frames: DataFrame) -> None:
    """Remove tables that written() made and nothing will read again."""
    for df in frames:
        spark, path = df.sparkSession, df.stored_at
        _remove(spark, path)
        _written[:] = [x for x in _written if x[1] != path]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder, read it back.

    Unlike a local checkpoint the files outlive any executor, and later steps
    read only the columns they need.  Nothing reads the write's own shuffle
    files again, so they are deleted with its end and do not wait for the
    driver's garbage collection.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As written(), in buckets by a key: a join on it shuffles the other side alone."""
    spark = df.sparkSession
    path, name = temporary(spark, "buckets"), f"lodestone_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name, format="parquet")
    return spark.table(name)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted), else as it is.

    df should be a written table or a small aggregate of one: it is counted first.
    """
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a
    pair of aggregations whose partial step shrinks a hot node before the
    shuffle; nodes without an edge are absent.  Every round is written to the
    shared folder, and only a change counter reaches the driver.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now = written(tidy(edges), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        # large star: every neighbour above a node is tied to the least of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: neighbours below a node, and the node, are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # a forest of stars: no node is both a leaf and a centre
        done = new.select("a").distinct().join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        once = done and new.groupBy("a").count().where("count > 1").isEmpty()
        now = new
        if once:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
