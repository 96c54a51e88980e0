"""Event logs and time: folds, windows, roll-ups, lag pairs, trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import lag_bucket

#: Bucket lengths in seconds; months, quarters and years are of fixed length.
LEVELS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "quarter": 7776000, "year": 31536000}


def epoch(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000


def bucket(ts: str, level: str) -> Column:
    return F.floor(epoch(ts) / LEVELS[level]).cast("long")


def fold(events: DataFrame, row: str, clock: Sequence[str], fields: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """Current state of each row: the last event by clock, an aggregation with a partial step."""
    seen = events if as_of is None else events.where(F.col(clock[0]) <= as_of)
    return seen.groupBy(row).agg(F.max_by(F.struct(*fields), F.struct(*clock)).alias("last"), F.count(F.lit(1)).alias("n_events")).select(row, "last.*", "n_events")


def merged_logs(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Grow-only set union."""
    return a.unionByName(b).dropDuplicates(list(key))


def compressed(df: DataFrame, ts: str, level: str, mask: str, keys: Sequence[str] = ()) -> DataFrame:
    """OR, count, first and last time of each bucket."""
    return df.groupBy(*keys, bucket(ts, level).alias("bucket")).agg(F.bit_or(mask).alias("mask"), F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def rolled_up(fine: DataFrame, into: int, keys: Sequence[str] = ()) -> DataFrame:
    """Coarser buckets from finer ones, each of them into of the finer."""
    return fine.groupBy(*keys, F.floor(F.col("bucket") / into).cast("long").alias("bucket")).agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def lag_pairs(df: DataFrame, ts: str, value: str, keys: Sequence[str], minutes: int = 256) -> DataFrame:
    """source, target, lag, n: ordered pairs of a key's events less than so many minutes apart.

    A range join by buckets: an event meets those of its own bucket and of the
    one before, both on an equal key, then the exact bound.
    """
    width = minutes * 60
    e = df.select(*keys, F.col(value).alias("v"), epoch(ts).alias("t")).withColumn("b", F.floor(F.col("t") / width))
    src = e.select(*keys, F.col("v").alias("source"), F.col("t").alias("t0"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    dst = e.select(*keys, F.col("v").alias("target"), F.col("t").alias("t1"), "b")
    gap = (F.col("t1") - F.col("t0")) / 60
    pairs = src.join(dst, [*keys, "b"]).where((F.col("t1") > F.col("t0")) & (gap < minutes))
    return pairs.groupBy("source", "target", lag_bucket(gap).alias("lag")).agg(F.count(F.lit(1)).alias("n"))


def first_after(captures: DataFrame, markers: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """captures with the first marker of their key at or after them: one union and one window, no range join."""
    a = captures.withColumn("_marker", F.lit(None).cast("timestamp_ntz")).withColumn("_side", F.lit(0))
    b = markers.select(*keys, ts).withColumn("_marker", F.col(ts)).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(0, Window.unboundedFollowing)
    return a.unionByName(b, allowMissingColumns=True).withColumn("marker_ts", F.min("_marker").over(w)).where("_side = 0").drop("_marker", "_side")


def trajectories(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str) -> DataFrame:
    """static, monotone, oscillating or divergent, and the mean step of each key's values."""
    d = F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_d", d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_d") > 0).alias("ups"), F.count_if(F.col("_d") < 0).alias("downs"), F.avg("_d").alias("slope"))
    kind = F.when((F.col("ups") == 0) & (F.col("downs") == 0), "static").when((F.col("ups") == 0) | (F.col("downs") == 0), "monotone").when(F.abs(F.col("ups") - F.col("downs")) <= 1, "oscillating").otherwise("divergent")
    return out.withColumn("trajectory", kind).withColumn("slope", F.coalesce("slope", F.lit(0.0)))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """session number: a new one after a gap."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = (epoch(ts) - F.lag(epoch(ts)).over(w) > gap_seconds).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def bucket_series(df: DataFrame, ts: str, level: str, end_bucket: int, n: int) -> DataFrame:
    """bucket, n over a fixed number of buckets up to an end, zeros filled in."""
    spark = df.sparkSession
    frame = spark.range(end_bucket - n + 1, end_bucket + 1).select(F.col("id").alias("bucket"))
    counts = df.groupBy(bucket(ts, level).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
