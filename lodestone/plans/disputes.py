"""Typed conflicts over facts made of orders, with their SQL: an order says its customer's priority, or size, for 60 days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import conflicts
from lodestone.operators.conflicts import Rule
from lodestone.plans.registry import Tables, query

RULES = (Rule("dim.order.priority", "priority"), Rule("dim.order.size", "size", single=False))
#: Seconds that an order's word holds.
HOLDS = 60 * 86_400


def facts(t: Tables) -> DataFrame:
    o = t("orders").withColumn("since", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    timed = F.col("o_orderkey") % 11 != 0  # the others have no known time
    predicate = F.when(F.col("o_orderkey") % 7 == 0, "size").when(F.col("o_orderkey") % 13 == 0, " Mood ").otherwise("Priority")
    said = F.when(F.col("o_orderkey") % 7 == 0, F.floor(F.col("o_totalprice") / 50_000).cast("string")).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").cast("string").alias("subject"), predicate.alias("predicate"), said.alias("object"), (F.col("o_orderkey") % 5).cast("string").alias("source"), (F.col("o_orderstatus") != "P").alias("active"), F.when(timed, F.col("since")).alias("since"), F.when(timed, F.col("since") + HOLDS).alias("until"))


_SIGNED = f"""WITH s AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderkey % 5 AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'size' WHEN o_orderkey % 13 = 0 THEN 'mood' ELSE 'priority' END AS dimension,
CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) WHEN o_orderkey % 13 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS value, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) END AS since FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT a.k, a.dimension, a.id AS a, b.id AS b, CASE WHEN a.value = b.value THEN 'agreement' WHEN a.dimension = 'size' THEN 'compatible_plurality' WHEN (a.since IS NULL) <> (b.since IS NULL) THEN 'candidate_review'
WHEN a.since IS NOT NULL AND abs(a.since - b.since) > {HOLDS} THEN 'historical_succession' WHEN a.dimension = 'mood' THEN 'candidate_review' ELSE 'proven_contradiction' END AS kind FROM s a JOIN s b ON a.k = b.k AND a.dimension = b.dimension AND a.id < b.id AND a.source <> b.source)"""


@query(_SIGNED + " SELECT dimension, a, b, kind FROM p WHERE kind IN ('proven_contradiction', 'candidate_review')")
def g23_conflicts(t: Tables) -> DataFrame:
    return conflicts.conflicts(conflicts.signatures(facts(t), RULES)).select("dimension", "a", "b", "kind")


@query(_SIGNED + ", k AS (SELECT unnest(['agreement', 'compatible_plurality', 'candidate_review', 'historical_succession', 'proven_contradiction']) AS kind) SELECT k.kind, count(p.kind) AS n FROM k LEFT JOIN p USING (kind) GROUP BY 1")
def z12_verdicts(t: Tables) -> DataFrame:
    """Every verdict's pairs, counted without forming those that agree or lie apart in time."""
    signed = conflicts.signatures(facts(t), RULES)
    counts = conflicts.verdict_counts(signed, conflicts.conflicts(signed))
    return t("orders").sparkSession.createDataFrame(list(counts.items()), "kind string, n long")


@query("WITH s AS (SELECT o_custkey AS k, o_orderkey % 5 AS source, lower(o_orderpriority) AS value FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0) SELECT 'order:' || k AS key, 'e:dim.order.priority#' || value AS value, count(*) AS facts, count(DISTINCT source) AS sources FROM s GROUP BY ALL HAVING count(DISTINCT source) > 1")
def z12_agreements(t: Tables) -> DataFrame:
    return conflicts.agreements(conflicts.signatures(facts(t), RULES)).where("dimension = 'priority'").select("key", "value", "facts", "sources")


@query("WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'inactive' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0 THEN 'unregistered' ELSE 'projected' END AS standing FROM orders) SELECT standing, count(*) AS n FROM s GROUP BY 1")
def g23_diagnostics(t: Tables) -> DataFrame:
    """What became of the facts."""
    return conflicts.signatures(facts(t), RULES).groupBy("standing").agg(F.count(F.lit(1)).alias("n"))
