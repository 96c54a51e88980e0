"""Ancestors of a directed graph as a stored table, and its increment for new edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import discard, written


def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    """node, ancestor of a path of a and then one of b; none leads back to its start.

    Merged, not broadcast: a closure's file is a small part of its pairs in memory.
    """
    return a.select("node", F.col("ancestor").alias("via")).hint("merge").join(b.select(F.col("node").alias("via"), "ancestor"), "via").where("node <> ancestor").select("node", "ancestor").distinct()


def ancestors(edges: DataFrame, most: int = 64) -> DataFrame:
    """node, ancestor of edges (child, parent): every ancestor over any number of edges; cycles do no harm, nobody is its own ancestor.

    Semi-naive and doubling: a round joins the pairs that the last one found
    with all pairs so far, on both sides, so rounds are as many as the
    logarithm of the longest path.  Every round is written.
    """
    every = written(edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "closure")
    new = every
    for _ in range(most):
        if new.isEmpty():
            return every
        longer = _composed(new, every).union(_composed(every, new))
        found = written(longer.distinct().join(every.hint("merge"), ["node", "ancestor"], "left_anti"), "closure-new")
        both = written(every.union(found), "closure")
        discard(every)
        every, new = both, found
    raise RuntimeError("the closure did not settle")


def extended(stored: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """The pairs that new edges (child, parent) add to a stored closure (node, ancestor).

    Only paths that hold a new edge are formed: chains of new edges first,
    linked by what is stored, then what stands below and above them.
    """
    fresh = written(edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "fresh")
    chains, new = fresh, fresh
    for _ in range(most):
        if new.isEmpty():
            break
        on = new.union(_composed(new, stored))  # what a chain's end reaches
        found = written(_composed(on, fresh).join(chains.hint("merge"), ["node", "ancestor"], "left_anti"), "chains-new")
        chains, new = written(chains.union(found), "chains"), found
    else:
        raise RuntimeError("the chains of new edges did not settle")
    up = chains.union(_composed(chains, stored)).distinct()
    return up.union(_composed(stored, up)).distinct().join(stored.hint("merge"), ["node", "ancestor"], "left_anti")
