"""Recall scores, rhythm, volatility and set comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.temporal import bucket

#: Seconds of the fixed-length calendar levels.
LEVELS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "quarter": 7776000, "year": 31536000}


def recall_scores(expected: Column, found: Column) -> dict[str, Column]:
    """Overlap, precision and reciprocal rank of the first hit of two arrays."""
    both, union = F.size(F.array_intersect(expected, found)), F.size(F.array_union(expected, found))
    hit = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), lambda i: F.array_contains(expected, F.get(found, i - 1)))
    return {
        "overlap": F.when(union == 0, 0.0).otherwise(both / union),
        "precision": F.when(F.size(found) == 0, 0.0).otherwise(both / F.size(found)),
        "mrr": F.when(F.size(hit) == 0, 0.0).otherwise(1 / F.element_at(hit, 1)),
    }


def cascade(events: DataFrame, time: str, mask: str) -> DataFrame:
    """OR and count of every level, each made of the finest one: one pass over the events."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1000000
    finest = events.groupBy(F.floor(seconds / LEVELS["hour"]).alias("hour")).agg(F.bit_or(mask).alias("m"), F.count(F.lit(1)).alias("c"))
    levels = F.array(*(F.struct(F.lit(name).alias("level"), F.floor(F.col("hour") * 3600 / size).alias("bucket")) for name, size in LEVELS.items()))
    return finest.select(F.explode(levels).alias("l"), "m", "c").groupBy("l.level", "l.bucket").agg(F.bit_or("m").alias("mask"), F.sum("c").alias("n"))


def spectrum(events: DataFrame, time: str, width: str, length: int) -> DataFrame:
    """Power of each frequency bin 1..length/2 of the counts of the last buckets; the series has a fixed length."""
    counts = events.groupBy(bucket(time, width).alias("b")).agg(F.count(F.lit(1)).alias("v"))
    recent = counts.crossJoin(F.broadcast(counts.agg(F.max("b").alias("hi")))).select((F.col("b") - F.col("hi") + length - 1).alias("i"), "v").where("i >= 0")
    angle = F.lit(2 * math.pi / length) * F.col("i") * F.col("bin")
    waves = recent.select("v", "i", F.explode(F.sequence(F.lit(1), F.lit(length // 2))).alias("bin")).groupBy("bin").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return waves.select("bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), (F.lit(float(length)) / F.col("bin")).alias("period"))


def volatility(events: DataFrame, node: str, time: str, decay: float) -> DataFrame:
    """Sum of exp(-decay * age in days) over the distinct times of a node."""
    last = events.agg(F.max(time).alias("now"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 86400000000
    return events.select(node, time).distinct().crossJoin(F.broadcast(last)).groupBy(node).agg(F.sum(F.exp(-decay * age)).alias("volatility"))


def share_difference(df: DataFrame, label: str, side: Column) -> DataFrame:
    """Share of each label where side holds, less its share elsewhere, over the union of labels."""
    counted = df.groupBy(label).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    everything = Window.partitionBy(F.lit(1))
    return counted.select(label, (F.col("a") / F.sum("a").over(everything) - F.col("b") / F.sum("b").over(everything)).alias("difference"))


def successors(events: DataFrame, entity: str, order: list[str], label: str) -> DataFrame:
    """How often a label follows another for the same entity, with its rank by count."""
    following = F.lead(label).over(Window.partitionBy(entity).orderBy(*order))
    counted = events.select(F.col(label).alias("anchor"), following.alias("target")).where("target is not null").groupBy("anchor", "target").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("n"), "target")))


def attributes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, field, value), nulls left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(key, F.inline(pairs)).where("value is not null")
