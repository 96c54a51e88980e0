"""What standing jobs decide: which links to propose, which jobs are open, where to resume, how lanes weigh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The temperature of the two-way softmax and the share of an earlier confidence that is retained.
TEMPERATURE, RETENTION = 0.2, 0.9
#: The lanes' weights before any bonus.
BASE_WEIGHTS = {"locus": 0.2, "bm25": 0.2, "vector": 0.2, "matrix": 0.1, "field_fit": 0.1, "diversity": 0.1, "graph": 0.1}


def contrastive(reward: Column, baseline: float) -> Column:
    """Two-way softmax of a mean reward against a baseline; no evidence (null) gives 0."""
    return F.coalesce(1 / (1 + F.exp((F.lit(baseline) - reward) / TEMPERATURE)), F.lit(0.0))


def dreamed(observations: DataFrame, key: Sequence[str], before: DataFrame, known: DataFrame, baseline: float, min_confidence: float, min_attempts: int) -> DataFrame:
    """observations (key, reward, attempts; one row a key) with confidence and decision.

    confidence is the larger of the contrastive one and what is retained of
    that in before (key, confidence); keys in known are suppressed, others
    emitted if they reach both gates.
    """
    seen = known.select(*key).distinct().withColumn("_known", F.lit(True))
    old = before.select(*key, F.col("confidence").alias("_old"))
    x = observations.join(old, list(key), "left").join(seen, list(key), "left")
    x = x.withColumn("confidence", F.greatest(contrastive(F.col("reward"), baseline), F.coalesce("_old", F.lit(0.0)) * RETENTION))
    passes = (F.col("confidence") >= min_confidence) & (F.col("attempts") >= min_attempts)
    decision = F.when(F.col("_known"), "suppressed").when(passes, "emitted").otherwise("below")
    return x.select(*key, "attempts", "confidence", decision.alias("decision"))


def open_jobs(jobs: DataFrame, acks: DataFrame, job: str, stream: Column | None = None) -> DataFrame:
    """Jobs without an acknowledgement, of one stream if a condition for it is given; claimed again until they have one."""
    wanted = jobs if stream is None else jobs.where(stream)
    return wanted.join(acks.select(job), job, "left_anti")


def settled(jobs: DataFrame, acks: DataFrame, job: str, order: str, status: str) -> DataFrame:
    """Each job with the status of its last acknowledgement (of equal ones the greatest), pending without one."""
    last = acks.groupBy(job).agg(F.max(F.struct(order, status))[status].alias("_status"))
    return jobs.join(last, job, "left").withColumn(status, F.coalesce("_status", F.lit("pending"))).drop("_status")


def resumed(log: DataFrame, cursors: DataFrame, stream: str, position: str) -> DataFrame:
    """Rows of a log past their stream's cursor (stream, cursor); a stream without a cursor starts at the beginning.

    Cursors are one row a stream; Spark broadcasts them if their size allows it.
    """
    at = cursors.select(stream, "cursor")
    return log.join(at, stream, "left").where(F.col("cursor").isNull() | (F.col(position) > F.col("cursor"))).drop("cursor")


def adaptive_weights(has_predicates: Column, has_text: Column, redundancy: Column, agreement: Column) -> dict[str, Column]:
    """Lane weights with their bonuses, summing to 1."""
    bonus = {
        "locus": F.when(has_predicates, 0.1), "field_fit": F.when(has_predicates, 0.1), "bm25": F.when(has_text, 0.1), "vector": F.when(has_text, 0.1),
        "diversity": F.when(redundancy > 0.5, 0.15), "graph": F.when(agreement > 0.6, 0.1),
    }
    raw = {lane: F.lit(w) + F.coalesce(bonus.get(lane, F.lit(0.0)), F.lit(0.0)) for lane, w in BASE_WEIGHTS.items()}
    total = sum(raw.values(), F.lit(0.0))
    return {lane: w / total for lane, w in raw.items()}


def steered(df: DataFrame, weights: dict[str, float]) -> Column:
    """The weighted sum of min-max scaled columns: 0 drops a column, a negative weight subtracts it; a uniform column counts as 0.5.

    df holds _low_c and _high_c for each column c of weights.
    """
    def scaled(c: str) -> Column:
        spread = F.col(f"_high_{c}") - F.col(f"_low_{c}")
        return F.when(spread == 0, 0.5).otherwise((F.col(c) - F.col(f"_low_{c}")) / spread)

    return sum((w * scaled(c) for c, w in weights.items() if w), F.lit(0.0))


def with_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with _low_c and _high_c of each column c: one row of aggregates, broadcast."""
    ranges = df.agg(*(f(c).alias(f"_{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))))
    return df.join(F.broadcast(ranges))
