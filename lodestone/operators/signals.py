"""Lag matrices, trajectories of categories, cohesion of groups, walks, and what standing jobs decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.storage import if_small, written


def lag_matrix(pairs: DataFrame, gap: str = "gap") -> DataFrame:
    """source, target, lag, n: lag is the place of the largest of 1, 2, 4 .. 128 that is not above the gap in minutes (1 to 255)."""
    inside = pairs.where((F.col(gap) >= 1) & (F.col(gap) <= 255))
    return inside.groupBy("source", "target", F.floor(F.log2(gap)).cast("int").alias("lag")).agg(F.count(F.lit(1)).alias("n"))


def recent_pairs(events: DataFrame, entity: str, order: Sequence[str], seconds: Column, label: str, most: int, within: float) -> DataFrame:
    """source, target, gap in minutes: each event with the most recent events (so many at most) of its entity within a time.

    The sources are a frame of the sorted window, so no event is joined with
    all of its entity's.
    """
    e = events.select(entity, *order, seconds.alias("_s"), F.col(label).alias("target"))
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-most, -1)
    held = e.withColumn("_before", F.collect_list(F.struct(F.col("_s").alias("s"), F.col("target").alias("source"))).over(w))
    near = held.select("target", "_s", F.explode(F.filter("_before", lambda x: (F.col("_s") - x["s"] > 0) & (F.col("_s") - x["s"] < within))).alias("x"))
    return near.select("x.source", "target", ((F.col("_s") - F.col("x.s")) / 60).alias("gap"))


def categorical_trajectory(events: DataFrame, entity: str, order: Sequence[str], label: str, threshold: float = 0.5) -> DataFrame:
    """entity, n, terminal, score, trajectory: static, oscillating (the last four alternate), convergent (the last run
    holds the threshold's share of all) or divergent."""
    back = Window.partitionBy(entity).orderBy(*(F.col(c).desc() for c in order))
    placed = events.select(entity, F.col(label).alias("v"), F.row_number().over(back).alias("r"), F.first(label).over(back).alias("terminal"))
    at = lambda i: F.max(F.when(F.col("r") == i, F.col("v")))
    g = placed.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.first("terminal").alias("terminal"), F.min(F.when(F.col("v") != F.col("terminal"), F.col("r"))).alias("other"), *(at(i).alias(f"t{i}") for i in range(1, 5)))
    share = F.when(F.col("other").isNull(), 1.0).otherwise((F.col("other") - 1) / F.col("n"))
    swing = (F.col("n") >= 4) & (F.col("t1") == F.col("t3")) & (F.col("t2") == F.col("t4")) & (F.col("t1") != F.col("t2"))
    kind = F.when(F.col("other").isNull(), "static").when(swing, "oscillating").when(share >= threshold, "convergent").otherwise("divergent")
    return g.select(entity, "n", "terminal", F.when(swing & F.col("other").isNotNull(), 0.0).otherwise(share).alias("score"), kind.alias("trajectory"))


def group_cohesion(vectors: DataFrame, group: str, item: str, vector: str, threshold: float, smallest: int = 3) -> DataFrame:
    """group, item, cohesion, outlier: mean cosine of each item to the others of its group, and whether it lies the
    threshold's deviations below the group's mean.

    The mean of an item's products with all others is its product with the
    group's sum, so no pairs are made: a sum by dimension, and a join.
    """
    unit = F.transform(vector, lambda x: x.cast("double") / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))))
    v = vectors.where(F.col(vector).isNotNull()).select(group, item, unit.alias("_u"))
    by_place = v.select(group, F.posexplode("_u").alias("_i", "_x")).groupBy(group, "_i").agg(F.sum("_x").alias("_s"))
    sums = by_place.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("_sum"))
    sizes = v.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    product = F.aggregate(F.zip_with("_u", "_sum", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    each = v.join(sums, group).join(sizes, group).select(group, item, "_n", F.when(F.col("_n") > 1, (product - 1) / (F.col("_n") - 1)).alias("cohesion"))
    m = each.groupBy(group).agg(F.avg("cohesion").alias("_m"), F.stddev_pop("cohesion").alias("_d"))
    z = F.when(F.col("_d") < 1e-6, 0.0).otherwise((F.col("cohesion") - F.col("_m")) / F.col("_d"))
    return each.join(m, group).select(group, item, "cohesion", ((F.col("_n") >= smallest) & (z <= -threshold)).alias("outlier"))


def restart_walk(near: DataFrame, seeds: DataFrame, rounds: int, restart: float = 0.15) -> DataFrame:
    """id, mass: the expected visits of a walk from the seeds (id) over near (src, dsts) that starts again with the given chance, after so many steps.

    What stands at a node without an edge starts again too.  Every round is written.
    """
    n = seeds.agg(F.count(F.lit(1)).alias("n"))
    start = written(seeds.join(F.broadcast(n)).select("id", (1.0 / F.col("n")).alias("own")), "walk")
    x = start.select("id", F.col("own").alias("mass"))
    for _ in range(rounds):
        sent = near.join(if_small(x), near["src"] == x["id"]).select(((1 - restart) * F.col("mass") / F.size("dsts")).alias("sent"), F.explode("dsts").alias("id"))
        came = written(sent.groupBy("id").agg(F.sum("sent").alias("came")), "walk")
        moved = came.agg(F.coalesce(F.sum("came"), F.lit(0.0)).alias("moved"))
        back = start.join(F.broadcast(moved)).select("id", (F.col("own") * (1 - F.col("moved"))).alias("back"))
        x = came.join(back, "id", "full").select("id", (F.coalesce("came", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("mass"))
    return x


def dealt_in_order(df: DataFrame, order: Sequence[Column], fill: int) -> DataFrame:
    """df with a column chest: runs of fill rows in an order, the last one shorter."""
    from lodestone.operators.datasets import numbered

    return numbered(df, order, "_place").withColumn("chest", F.floor(F.col("_place") / fill)).drop("_place")


def near_probes(df: DataFrame, probes: DataFrame, distance: Column, most: float) -> DataFrame:
    """Pairs (a, b), a < b, of probes (probe, ..; a bounded number) and rows (item, ..) no further apart than that."""
    pairs = df.join(F.broadcast(probes)).where((F.col("item") != F.col("probe")) & (distance <= most))
    return pairs.select(F.least("item", "probe").alias("a"), F.greatest("item", "probe").alias("b")).distinct()
