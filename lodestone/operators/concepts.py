"""Formal concept analysis over rows with attributes: derivations, concepts to a fixed point, the canonical basis.

Rows with equal attributes are one class with a count, so work grows with
distinct rows.  Which classes hold an intent is found by one equi-join on the
intent's rarest attribute, the others are checked in the joined row; the empty
intent is keyed by null, which every class has as a key of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import discard, union, written

#: Attributes up to which a context may have them all in one row: what no row
#: holds has every attribute as its intent, and a basis extends closed sets by
#: each attribute.  Concepts have no such bound.
MOST_ATTRIBUTES = 10_000


class Context(NamedTuple):
    """Classes (xs, n) of equal rows and attributes (item, n), both written."""

    classes: DataFrame
    attributes: DataFrame


def _clean(items: str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array().cast("array<string>")))))


def context(rows: DataFrame, items: str = "items") -> Context:
    """The context of rows with an array of attributes (strings).

    Null and repeated attributes of a row are dropped; a row without any, or
    with a null array, counts among all rows.
    """
    classes = written(rows.select(_clean(items).alias("xs")).groupBy("xs").agg(F.count(F.lit(1)).alias("n")), "context")
    each = classes.select("n", F.explode("xs").alias("item"))
    return Context(classes, written(each.groupBy("item").agg(F.sum("n").alias("n")), "attributes"))


def _universe(attributes: DataFrame) -> DataFrame:
    """One row: all attributes in order; more than MOST_ATTRIBUTES raise an error."""
    many = F.when(F.count(F.lit(1)) > MOST_ATTRIBUTES, F.raise_error(F.lit("too many attributes for one row"))).otherwise(F.array_sort(F.collect_list("item")))
    first = attributes.select("item").limit(MOST_ATTRIBUTES + 1)
    return F.broadcast(first.agg(many.alias("universe")))


def _holding(sets: DataFrame, intents: DataFrame, attributes: DataFrame) -> DataFrame:
    """Each row of sets (xs and more) with each of intents (intent and more) whose attributes are all in xs."""
    each = intents.select("intent", F.explode_outer("intent").alias("item")).join(attributes.withColumnRenamed("n", "held"), "item", "left")
    rarest = each.groupBy("intent").agg(F.min_by("item", F.struct(F.coalesce("held", F.lit(0)), "item")).alias("anchor"))
    keyed = intents.join(rarest, "intent")
    open_ = sets.withColumn("key", F.explode(F.array_append("xs", F.lit(None).cast("string"))))
    return open_.join(keyed, F.col("key").eqNullSafe(F.col("anchor"))).where(F.size(F.array_except("intent", "xs")) == 0).drop("key", "anchor")


def extents(rows: DataFrame, id_column: str, intents: DataFrame, items: str = "items") -> DataFrame:
    """(intent, id) for each row that holds all attributes of an intent; the empty intent has all rows, an unknown attribute none."""
    sets = rows.select(F.col(id_column), _clean(items).alias("xs"))
    known = sets.select(F.explode("xs").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return _holding(sets, intents.select(F.array_sort(F.array_distinct("intent")).alias("intent")).distinct(), known).select("intent", id_column)


def shared(rows: DataFrame, id_column: str, members: DataFrame, items: str = "items") -> DataFrame:
    """(part, intent): the attributes that all of a part's rows hold; members are (part, id), a part of a null id alone is empty and has every attribute."""
    sets = rows.select(F.col(id_column), _clean(items).alias("xs"))
    of = members.select("part", id_column).distinct().join(sets, id_column).select("part", "xs")
    counted = of.select("part", F.explode(F.array_append("xs", F.lit(None).cast("string"))).alias("item")).groupBy("part", "item").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.where("item IS NULL").select("part", F.col("n").alias("size"))
    full = sizes.join(counted.where("item IS NOT NULL"), "part", "left").groupBy("part").agg(F.array_sort(F.collect_list(F.when(F.col("n") == F.col("size"), F.col("item")))).alias("intent"))
    every = _universe(sets.select(F.explode("xs").alias("item")).distinct())
    parts = members.select("part").distinct().join(full, "part", "left").join(every)
    return parts.select("part", F.coalesce("intent", "universe").alias("intent"))


def _counts(ctx: Context, intents: DataFrame) -> DataFrame:
    """Written (intent, item, n): how many rows hold the intent and the item; the item null counts the extent."""
    held = _holding(ctx.classes, intents, ctx.attributes)
    each = held.select("intent", "n", F.explode(F.array_append("xs", F.lit(None).cast("string"))).alias("item"))
    return written(each.groupBy("intent", "item").agg(F.sum("n").alias("n")), "intent-counts")


def _closed(counts: DataFrame) -> DataFrame:
    """(intent, extent, closed) of intents that some row holds."""
    extent = counts.where("item IS NULL").select("intent", F.col("n").alias("extent"))
    same = extent.join(counts.where("item IS NOT NULL"), "intent", "left")
    # no more than one row's attributes are in all rows of an extent
    return same.groupBy("intent", "extent").agg(F.array_sort(F.collect_list(F.when(F.col("n") == F.col("extent"), F.col("item")))).alias("closed"))


def closures(ctx: Context, intents: DataFrame) -> DataFrame:
    """(intent, extent, closed): how many rows hold the intent, and all that those hold; without a row, every attribute."""
    asked = written(intents.select(F.array_sort(F.array_distinct("intent")).alias("intent")).distinct(), "intents")
    out = asked.join(_closed(_counts(ctx, asked)), "intent", "left").join(_universe(ctx.attributes))
    return out.select("intent", F.coalesce("extent", F.lit(0)).cast("long").alias("extent"), F.coalesce("closed", "universe").alias("closed"))


def concepts(ctx: Context, min_support: int = 2, max_intent: int = 8, depth: int | None = None) -> DataFrame:
    """(intent, support): every closed non-empty intent of at least min_support rows and at most max_intent attributes.

    depth 1 gives the closures of single attributes, 2 those of pairs as well;
    without it rounds go on to the fixed point.  A round counts the items next
    to each intent, so one pass gives closures and the supports of all
    extensions: those below min_support are never formed.  A closed intent has
    an attribute more than what it came from, so max_intent bounds the rounds.
    Intents above max_intent are left with all that extends them.
    """
    least = max(min_support, 1)
    found: list[DataFrame] = []
    new = written(ctx.attributes.where(F.col("n") >= least).select(F.array("item").alias("intent")), "intents")
    for _ in range(max_intent if depth is None else min(depth, max_intent)):
        if new.isEmpty():
            break
        counts = _counts(ctx, new)
        fresh = _closed(counts).where(F.size("closed") <= max_intent).groupBy("closed").agg(F.min("intent").alias("seed"), F.max("extent").alias("support"))
        if found:
            fresh = fresh.join(union(found).select(F.col("intent").alias("closed")), "closed", "left_anti")
        fresh = written(fresh.withColumnRenamed("closed", "intent"), "concepts")
        found.append(fresh.select("intent", "support"))
        more = fresh.where(F.size("intent") < max_intent).join(counts.withColumnRenamed("intent", "seed"), "seed").where((F.col("n") >= least) & (F.col("n") < F.col("support")) & F.col("item").isNotNull())
        longer = more.select(F.array_sort(F.array_append("intent", F.col("item"))).alias("intent")).distinct()
        after = written(longer.join(union(found).select("intent"), "intent", "left_anti"), "intents")
        discard(counts, new)
        new = after
    return union(found) if found else new.select("intent", F.lit(0).cast("long").alias("support")).limit(0)


def implications(ctx: Context, max_premise: int = 3) -> DataFrame:
    """(premise, conclusion, support): the canonical basis up to premises of max_premise attributes.

    Every row that holds the premise holds the conclusion; support counts
    those rows, and is 0 where no row holds the premise (it then implies every
    other attribute).  A context without rows has no implication.  The sets of
    one size are treated together (Kriegel and Borchmann, 2015): a set that
    the smaller premises enlarge waits at its new size, any other is closed;
    where the closure is larger it is an implication, and each closure plus
    one attribute is a later set.  A cap on the number is a limit of the result.
    """
    base: list[DataFrame] = []
    empty = ctx.classes.limit(1).select(F.array().cast("array<string>").alias("intent"))
    waiting = [written(empty, "premises")]
    for size in range(max_premise + 1):
        now = written(union(waiting).where(F.size("intent") == size).distinct(), "premises")
        still = now
        if base:
            rules = union(base).select(F.col("premise").alias("intent"), "closed")
            met = _holding(now.select(F.col("intent").alias("xs")), rules, ctx.attributes)
            gained = met.select("xs", F.explode("closed").alias("item")).groupBy("xs").agg(F.collect_set("item").alias("items"))
            grown = gained.select(F.col("xs").alias("intent"), F.array_sort(F.array_union("xs", "items")).alias("grown")).where("intent <> grown")
            grown = written(grown, "premises-grown")
            waiting.append(grown.where(F.size("grown") <= max_premise).select(F.col("grown").alias("intent")))
            still = now.join(grown, "intent", "left_anti")
        done = written(closures(ctx, still), "premises-closed")
        base.append(done.where("intent <> closed").select(F.col("intent").alias("premise"), "closed", "extent"))
        if size < max_premise:
            room = done.where(F.size("closed") < max_premise).join(_universe(ctx.attributes))
            one_more = room.select("closed", F.explode(F.array_except("universe", "closed")).alias("item"))
            waiting.append(written(one_more.select(F.array_sort(F.array_append("closed", F.col("item"))).alias("intent")).distinct(), "premises"))
    return union(base).select("premise", F.array_except("closed", "premise").alias("conclusion"), F.col("extent").alias("support"))
