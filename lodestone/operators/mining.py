"""Co-occurrence, association rules, concepts and graphs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.storage import BROADCAST_ROWS, components, if_small, written


def items(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """row, item: "column:value" for every value that isn't null."""
    made = F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns))
    return df.select(F.col(row).alias("row"), F.explode(F.array_compact(made)).alias("item"))


def cooccurrence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n for ordered pairs of a row's items with the diagonal.

    Equal rows are counted first, so pairs are made of distinct combinations
    only; nothing is joined.
    """
    combined = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    made = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns)))
    one = combined.select("_n", made.alias("xs")).select("_n", "xs", F.explode("xs").alias("a"))
    return one.select("_n", "a", F.explode("xs").alias("b")).groupBy("a", "b").agg(F.sum("_n").alias("n"))


def rules(pairs: DataFrame, total: int, min_support: float = 0.0) -> DataFrame:
    """Pairwise rules with support, confidence, lift, leverage and conviction (null where confidence is 1)."""
    one = pairs.where("a = b").select(F.col("a").alias("i"), F.col("n").alias("ni"))
    x = pairs.where("a <> b").join(one.select(F.col("i").alias("a"), F.col("ni").alias("na")), "a").join(one.select(F.col("i").alias("b"), F.col("ni").alias("nb")), "b")
    s, c, pb = F.col("n") / total, F.col("n") / F.col("na"), F.col("nb") / total
    out = x.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), s.alias("support"), c.alias("confidence"), (c / pb).alias("lift"), (s - F.col("na") / total * pb).alias("leverage"), F.when(c < 1, (1 - pb) / (1 - c)).alias("conviction"))
    return out.where(F.col("support") >= min_support)


def frequent_itemsets(df: DataFrame, columns: Sequence[str], min_support: float, max_items: int = 3) -> tuple[DataFrame, int]:
    """items (sorted), freq of the itemsets of at most max_items that enough rows hold, written, and the number of all rows.

    Equal rows are counted first and values that are not frequent go before
    sets are made; nothing but distinct combinations and their sets is shuffled.
    """
    rows = written(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "combinations")
    total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    least = math.ceil(Decimal(str(min_support)) * total)
    for c in columns:
        often = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("_n").alias("_f")).where(F.col("_f") >= least).select(F.col(c).alias("_v"))
        rows = rows.join(if_small(often), F.col(c) == F.col("_v"), "left").withColumn(c, F.when(F.col("_v").isNotNull(), F.col(c))).drop("_v")
    cells = {c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns}
    made = [F.array(*(cells[c] for c in some)) for k in range(1, max_items + 1) for some in combinations(columns, k)]
    sets = rows.groupBy(*columns).agg(F.sum("_n").alias("_n")).select("_n", F.explode(F.array(*made)).alias("items")).where(~F.exists("items", lambda x: x.isNull()))
    counted = sets.groupBy(F.array_sort("items").alias("items")).agg(F.sum("_n").alias("freq")).where(F.col("freq") >= least)
    return written(counted, "itemsets"), total


def itemset_rules(df: DataFrame, columns: Sequence[str], min_support: float, max_items: int = 3) -> DataFrame:
    """Rules of several antecedents and one consequent from frequent itemsets."""
    sets, total = frequent_itemsets(df, columns, min_support, max_items)
    split = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("consequent")).withColumn("antecedent", F.array_sort(F.array_remove("items", F.col("consequent"))))
    x = split.join(sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("fa")), "antecedent").join(sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("freq").alias("fc")), "consequent")
    c = F.col("freq") / F.col("fa")
    return x.select(F.array_join("antecedent", "&").alias("antecedent"), "consequent", (F.col("freq") / total).alias("support"), c.alias("confidence"), (c / (F.col("fc") / total)).alias("lift"))


def pmi(pairs: DataFrame, total: int) -> DataFrame:
    """log2 p(ab) / p(a) p(b) of co-occurring items a < b."""
    one = pairs.where("a = b").select(F.col("a").alias("i"), F.col("n").alias("ni"))
    x = pairs.where("a < b").join(one.select(F.col("i").alias("a"), F.col("ni").alias("na")), "a").join(one.select(F.col("i").alias("b"), F.col("ni").alias("nb")), "b")
    return x.select("a", "b", F.log2(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb"))).alias("pmi"))


def field_presence(df: DataFrame, columns: Sequence[str], fields: int = 10, width: int = 6) -> DataFrame:
    """column_name, field, field_bit, n: rows that hold each bit of each field.

    All cells are sums of one aggregation, so a row is read once and nothing
    but the sums is shuffled.
    """
    cells = [(c, i) for c in columns for i in range(fields * width)]
    one = df.agg(*(F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1))).alias(f"{c}_{i}") for c, i in cells))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(i // width).alias("field"), F.lit(i % width).alias("field_bit"), F.coalesce(f"{c}_{i}", F.lit(0).cast("long")).alias("n")) for c, i in cells))
    return one.select(F.inline(rows))


def closure(transactions: DataFrame, intent: Sequence[str], items_column: str = "items") -> DataFrame:
    """Support and closure of an intent: the items that all rows with it share.

    Items of the extent are counted, and those in every row kept.
    """
    extent = transactions.where(F.size(F.array_except(F.array(*map(F.lit, intent)), F.col(items_column))) == 0)
    n = extent.agg(F.count(F.lit(1)).alias("support"))
    each = extent.select(F.explode(F.array_distinct(items_column)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return each.join(F.broadcast(n)).where(F.col("n") == F.col("support")).groupBy("support").agg(F.array_sort(F.collect_list("item")).alias("closure"))


def pair_concepts(transactions: DataFrame, items_column: str = "items") -> DataFrame:
    """(a, b, extent, intent): for each pair of attributes that some row holds, how many rows hold both, and what all of those hold (joined by ;).

    Equal rows are counted before pairs are made; a row makes as many as its
    own attributes allow.
    """
    rows = transactions.select(F.array_sort(F.array_distinct(items_column)).alias("xs")).groupBy("xs").agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.select("xs", "n", F.posexplode("xs").alias("i", "a")).select("xs", "n", "a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b"))
    held = pairs.select("a", "b", "n", F.explode("xs").alias("item")).groupBy("a", "b", "item").agg(F.sum("n").alias("n"))
    every = held.groupBy("a", "b").agg(F.max("n").alias("extent"), F.array_sort(F.collect_list(F.struct("item", "n"))).alias("held"))
    return every.select("a", "b", "extent", F.array_join(F.transform(F.filter("held", lambda h: h["n"] == F.col("extent")), lambda h: h["item"]), ";").alias("intent"))


def attribute_concepts(pairs: DataFrame) -> DataFrame:
    """(a, extent, intent as an array): the concept that each single attribute generates, from co-occurrence counts with the diagonal."""
    own = pairs.where("a = b").select("a", F.col("n").alias("extent"))
    return pairs.join(own, "a").where("n = extent").groupBy("a", "extent").agg(F.array_sort(F.collect_list("b")).alias("intent"))


#: Subjects of a row up to which they travel with it.
CARRIED = 64


def subject_edges(df: DataFrame, row: str, subject: str, target: str, most: int = 50, carried: int = CARRIED) -> DataFrame:
    """a < b, each once: row and target of df, and rows among the first `most` (by id) of one subject.

    A row goes to a subject with its lower subjects, so a pair is made at the
    least subject that both share and is not shuffled.  Only pairs of a row
    that is a target too, or has more than `carried` subjects, are shuffled,
    with the direct edges, to be made distinct.
    """
    first = Window.partitionBy("_s").orderBy(F.asc_nulls_last("_r"))
    held = df.where(F.col(subject).isNotNull()).select(F.col(subject).alias("_s"), F.col(row).alias("_r")).repartition("_s").distinct()
    few = held.withColumn("_k", F.row_number().over(first)).where((F.col("_k") <= most) & F.col("_r").isNotNull())
    targets = df.select(F.col(target).alias("_r")).distinct().withColumn("aimed", F.lit(True))
    own = few.groupBy("_r").agg(F.array_sort(F.collect_list("_s")).alias("ss")).join(targets, "_r", "left")
    low = F.when(F.col("aimed").isNull() & (F.size("ss") <= carried), F.col("ss"))
    sent = own.select("_r", low.alias("low"), F.posexplode("ss").alias("i", "s")).select("s", F.struct(F.col("_r").alias("id"), F.expr("slice(low, 1, i)").alias("low")).alias("x"))
    xs = written(sent.groupBy("s").agg(F.array_sort(F.collect_list("x")).alias("xs")), "subjects")
    pairs = xs.select("xs", F.posexplode("xs").alias("i", "x")).select("x", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("y"))
    ends = (F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    again = F.col("x.low").isNull() | F.col("y.low").isNull()
    direct = df.where(F.col(row) != F.col(target)).select(F.least(row, target).alias("a"), F.greatest(row, target).alias("b"))
    return pairs.where(~again & ~F.arrays_overlap("x.low", "y.low")).select(*ends).union(pairs.where(again).select(*ends).union(direct).distinct())


def sharing(df: DataFrame, group: str, node: str) -> DataFrame:
    """src, dst in both directions, each once, of different nodes that share a group.

    A group's nodes are one short array, so rows are shuffled once; pairs are
    made in one direction, made distinct and then turned.
    """
    held = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(node)).alias("xs")).where(F.size("xs") > 1)
    half = held.select("xs", F.posexplode("xs").alias("i", "src")).select("src", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("dst")).distinct()
    return half.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dsts of edges (src, dst), written: what rounds over a graph join with, so no round shuffles a row an edge."""
    return cut(edges.groupBy("src").agg(F.collect_list("dst").alias("dsts")))


def eigenvector(near: DataFrame, rounds: int = 20) -> DataFrame:
    """Power iteration on the transposed adjacency plus the identity, unit L2 norm; near: src, dsts.  Every round is written."""
    nodes = near.select(F.col("src").alias("id")).union(near.select(F.explode("dsts").alias("id"))).distinct()
    x = cut(nodes.withColumn("x", F.lit(1.0)))
    small = x.count() <= BROADCAST_ROWS
    for _ in range(rounds):
        came = near.join(F.broadcast(x) if small else x, near["src"] == x["id"]).select("x", F.explode("dsts").alias("id")).groupBy("id").agg(F.sum("x").alias("in"))
        grown = cut(x.join(came, "id", "left").select("id", (F.col("x") + F.coalesce("in", F.lit(0.0))).alias("x")))
        length = grown.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
        x = grown.join(F.broadcast(length)).select("id", (F.col("x") / F.col("len")).alias("x"))
    return x


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table in the shared folder."""
    return written(df, "graph")


def communities(edges: DataFrame) -> DataFrame:
    """id, community: connected components, named by their least member; edges: src, dst.

    Alternating star steps, so the rounds grow with the logarithm of the longest path.
    """
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.select(F.col("node").alias("id"), F.col("component").alias("community"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """id, hop: breadth-first frontiers by self-join with an anti join of what was seen."""
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        frontier = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def weights_by_type(kind: Column, age: Column) -> Column:
    """exp(-rate age); rates: entity .1, relation .2, temporal .5, numerical .8."""
    rate = F.when(kind == "entity", 0.1).when(kind == "relation", 0.2).when(kind == "temporal", 0.5).when(kind == "numerical", 0.8).otherwise(0.0)
    return F.exp(-rate * age)


def facet_rules(df: DataFrame, row: str, columns: Sequence[str], labels: int = 64, exemplars: int = 5) -> DataFrame:
    """Pairwise rules over the first labels facets in order, each with the least ids of rows that hold both.

    Exemplars come from the least rows of each distinct combination, so no
    pairs are made of single rows.
    """
    pairs = cooccurrence(df, columns)
    kept = pairs.select("a").distinct().orderBy("a").limit(labels)
    pairs = pairs.join(F.broadcast(kept), "a", "left_semi").join(F.broadcast(kept.withColumnRenamed("a", "b")), "b", "left_semi")
    first = Window.partitionBy(*columns).orderBy(row)
    few = df.select(row, *columns).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= exemplars)
    made = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in columns)))
    held = few.select(row, made.alias("xs")).select(row, "xs", F.explode("xs").alias("antecedent")).select(row, "antecedent", F.explode("xs").alias("consequent")).where("antecedent <> consequent")
    best = held.withColumn("_k", F.row_number().over(Window.partitionBy("antecedent", "consequent").orderBy(row))).where(F.col("_k") <= exemplars)
    ids = best.groupBy("antecedent", "consequent").agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias("exemplars"))
    return rules(pairs, df.count()).join(ids, ["antecedent", "consequent"])


def covers(concepts: DataFrame, items_column: str = "items") -> DataFrame:
    """(below, above, added) for intents (arrays) where below's items are among above's and no third intent lies between.

    Subsets are found by counting shared items, not by comparing all pairs.
    """
    c = concepts.select(F.array_sort(F.array_distinct(items_column)).alias("xs")).distinct()
    item = c.select("xs", F.explode("xs").alias("item"))
    met = item.toDF("below", "item").join(item.toDF("above", "item"), "item").groupBy("below", "above").agg(F.count(F.lit(1)).alias("n"))
    inside = met.where((F.col("n") == F.size("below")) & (F.size("below") < F.size("above"))).select("below", "above")
    between = inside.toDF("below", "middle").join(inside.toDF("middle", "above"), "middle").select("below", "above")
    return inside.join(between, ["below", "above"], "left_anti").withColumn("added", F.array_sort(F.array_except("above", "below")))
