"""Closures, communities and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import closure, communities
from lodestone.plans.registry import Tables, query
from lodestone.plans.themes import _PAIRS, _brands

_EDGES = "e AS (SELECT p_partkey AS child, p_partkey // (2 + p_size % 3) AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey % 10 = 0 AND p_partkey > 0)"
_CLOSED = f"WITH RECURSIVE {_EDGES}, c AS (SELECT child AS node, parent AS ancestor FROM e WHERE child <> parent UNION SELECT c.node, e.parent FROM c JOIN e ON e.child = c.ancestor WHERE e.child <> e.parent)"


def _part_edges(t: Tables) -> DataFrame:
    """A part hangs under the one of its number divided by 2 to 4, every tenth under a fifth as well."""
    p = t("part").where("p_partkey > 0")
    one = p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey DIV (2 + p_size % 3)").alias("parent"))
    return one.union(p.where("p_partkey % 10 = 0").select("p_partkey", F.expr("p_partkey DIV 5")))


@query(_CLOSED + " SELECT node, ancestor FROM c")
def x31_ancestors(t: Tables) -> DataFrame:
    return closure.ancestors(_part_edges(t))


@query(_CLOSED + " SELECT node, count(*) AS ancestors, max(ancestor) AS nearest FROM c GROUP BY 1")
def x31_extended(t: Tables) -> DataFrame:
    """The same closure, four fifths of the edges first and the others added to what is stored."""
    edges = _part_edges(t)
    stored = closure.ancestors(edges.where("child % 5 <> 0"))
    both = stored.union(closure.extended(stored, edges.where("child % 5 = 0")))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("ancestors"), F.max("ancestor").alias("nearest"))


@query()
def g05_propagated(t: Tables) -> DataFrame:
    """Brands by what they are ordered with: the pairs that come together more often than the mean."""
    pairs = _brands(t)
    mean = pairs.agg(F.avg("weight").alias("mean"))
    return communities.propagated(pairs.join(F.broadcast(mean)).where("weight > mean").select("a", "b", "weight"))


@query(f"WITH {_PAIRS}, x AS (SELECT row AS a, col AS b, value AS weight FROM o WHERE row < col), s AS (SELECT x.*, substr(a, 7, 1) AS ca, substr(b, 7, 1) AS cb FROM x), w AS (SELECT ca AS community, sum(weight) AS weight FROM s WHERE ca = cb GROUP BY 1), n AS (SELECT substr(node, 7, 1) AS community, count(*) AS nodes FROM (SELECT a AS node FROM x UNION SELECT b FROM x) GROUP BY 1) SELECT community, nodes, CAST(weight AS BIGINT) AS weight FROM n JOIN w USING (community) ORDER BY weight DESC, nodes DESC, community LIMIT 1")
def g17_dominant(t: Tables) -> DataFrame:
    """Of the brands by maker, the maker whose brands weigh most together."""
    pairs = _brands(t)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return communities.dominant(pairs, nodes.withColumn("community", F.substring("node", 7, 1)))


_SENTENCES = r"s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM documents)"


@query(f"WITH {_SENTENCES} SELECT doc_id, least(count(*), 3) AS sentences FROM s GROUP BY 1")
def x17_summary_sizes(t: Tables) -> DataFrame:
    """How many sentences each document's summary of three has."""
    return communities.lexrank(t("documents"), 3, 6).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


@query()
def x17_lexrank(t: Tables) -> DataFrame:
    """The three most central sentences of every document."""
    return communities.lexrank(t("documents"), 3).select("doc_id", "place", "sentence")
