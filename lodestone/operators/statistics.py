"""Aggregate lenses: information measures, calibration, anomaly scores, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import binary_entropy_term, wilson_lower


def distribution(df: DataFrame, label: str) -> DataFrame:
    """label, n, share; nulls excluded."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total")).alias("share"))


def entropy(df: DataFrame, label: str) -> DataFrame:
    return distribution(df, label).agg(F.sum(binary_entropy_term(F.col("share"))).alias("entropy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """h_a, h_b, h_ab, mi and nmi in bits over rows where both are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    joint = known.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # margins of the joint counts: grouping sets of a table that is already small
    sets = joint.cube(a, b).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    n = F.col("n").cast("double")
    h = lambda level: F.sum(F.when(F.col("level") == level, n * F.log2(n)))
    total = F.max(F.when(F.col("level") == 3, n))
    one = sets.agg(total.alias("t"), *(h(k).alias(f"s{k}") for k in (0, 1, 2)))
    H = lambda k: F.log2("t") - F.col(f"s{k}") / F.col("t")
    out = one.select(H(1).alias("h_a"), H(2).alias("h_b"), H(0).alias("h_ab"))
    mi = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    return out.withColumn("mi", mi).withColumn("nmi", F.when(F.col("h_a") + F.col("h_b") == 0, 0.0).otherwise(2 * mi / (F.col("h_a") + F.col("h_b"))))


def aligned(p: DataFrame, q: DataFrame, label: str, smoothing: float = 0.0) -> DataFrame:
    """label, p, q: shares over the union of labels."""
    a = p.groupBy(label).agg(F.count(F.lit(1)).alias("a"))
    b = q.groupBy(label).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, label, "full_outer").select(label, (F.coalesce("a", F.lit(0)) + smoothing).alias("a"), (F.coalesce("b", F.lit(0)) + smoothing).alias("b"))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return both.join(F.broadcast(total)).select(label, (F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))


def divergences(pq: DataFrame) -> DataFrame:
    """kl (terms with q = 0 left out), cross_entropy and js of shares p, q."""
    p, q, m = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2
    term = lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(x / y)).otherwise(0.0)
    return pq.agg(F.sum(term(p, q)).alias("kl"), F.sum(F.when((p > 0) & (q > 0), -p * F.log2(q)).otherwise(0.0)).alias("cross_entropy"), (F.sum(term(p, m)) / 2 + F.sum(term(q, m)) / 2).alias("js"))


def calibration(df: DataFrame, confidence: Column, outcome: Column, bins: int = 20) -> DataFrame:
    """bin, n, hits over equal bins of confidence."""
    return df.groupBy(F.least(F.lit(bins - 1), F.floor(confidence * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome.cast("long")).alias("hits"))


def calibration_errors(hist: DataFrame, bins: int = 20) -> DataFrame:
    """Expected calibration error and binned Brier score against the bins' midpoints."""
    gap = F.col("hits") / F.col("n") - (F.col("bin") + 0.5) / bins
    total = F.sum("n")
    return hist.agg((F.sum(F.abs(gap) * F.col("n")) / total).alias("ece"), (F.sum(gap * gap * F.col("n")) / total).alias("brier"))


def outcomes(df: DataFrame, action: str, outcome: str, success: Column) -> DataFrame:
    """Trials, successes and their Wilson lower bound for each action and outcome."""
    out = df.groupBy(action, outcome).agg(F.count(F.lit(1)).alias("trials"), F.sum(success.cast("long")).alias("successes"))
    return out.withColumn("lower", wilson_lower(F.col("successes"), F.col("trials")))


def upper_median(x: str) -> Column:
    """sorted[n div 2] of a group; of the two middle values the upper."""
    s = F.array_sort(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def modified_z(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """0.6745 (x - med) / MAD in each group, by upper medians; 0 where MAD is 0.

    Medians come from counts of distinct values, whose running sums give the
    middle place, so no group's values are collected.
    """
    def middle(d: DataFrame, c: str, name: str) -> DataFrame:
        counts = d.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        run = Window.partitionBy(*keys).orderBy(c)
        place = counts.withColumn("_upto", F.sum("_n").over(run)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        return place.where("_upto > _all div 2").groupBy(*keys).agg(F.min(c).alias(name))

    med = middle(df, x, "med")
    off = df.join(med, list(keys)).withColumn("_off", F.abs(F.col(x) - F.col("med")))
    mad = middle(off, "_off", "mad")
    return off.drop("_off").join(mad, list(keys)).withColumn("z", F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * (F.col(x) - F.col("med")) / F.col("mad")))


def z_scores(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """z against the group's mean and population deviation, 0 below 1e-6.

    Two moments of each group are aggregated and joined back: a hot group is
    never put in order.
    """
    m = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    return df.join(m, list(keys)).withColumn("z", F.when(F.col("sd") < 1e-6, 0.0).otherwise((F.col(x) - F.col("mean")) / F.col("sd")))


def rolling_z(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, width: int) -> DataFrame:
    """z against the width rows before and the row itself."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-width, 0)
    sd = F.stddev_pop(x).over(w)
    return df.withColumn("z", F.when(sd < 1e-9, 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / sd))


def min_max(df: DataFrame, x: str) -> DataFrame:
    """x on [0, 1]; a column of one value is 0.5, all zeros stay 0."""
    lim = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    v = F.when((F.col("lo") == 0) & (F.col("hi") == 0), 0.0).when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return df.join(F.broadcast(lim)).withColumn("scaled", v).drop("lo", "hi")


def momentum(df: DataFrame, category: str, weight: Column) -> DataFrame:
    """Weighted share less raw share of each category."""
    c = df.groupBy(category).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    return c.join(F.broadcast(t)).select(category, (F.col("w") / F.col("tw") - F.col("n") / F.col("tn")).alias("momentum"))


def cohesion(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Sum of robust z (1.4826 MAD) of numbers and -log2 frequency of categories for each row."""
    meds = df.agg(*(F.median(c).alias(f"_m_{c}") for c in numeric))
    mads = df.join(F.broadcast(meds)).agg(*(F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in numeric))
    out = df.join(F.broadcast(meds)).join(F.broadcast(mads))
    score = sum((F.when(F.col(f"_d_{c}") == 0, 0.0).otherwise(F.abs(F.col(c) - F.col(f"_m_{c}")) / (1.4826 * F.col(f"_d_{c}"))) for c in numeric), F.lit(0.0))
    for c in categorical:
        out = out.join(distribution(df, c).select(c, (-F.log2("share")).alias(f"_f_{c}")), c)
        score = score + F.col(f"_f_{c}")
    return out.withColumn("score", score).select(*df.columns, "score")
