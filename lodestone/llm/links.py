"""Links between sets that share blocks, without all pairs of a block.

Used by the n-gram join and by paragraph deduplication.  A member is a set
(named by a 64-bit hash, so equal sets are one member) that stands in some
blocks; two members can only be similar if they share a block.  To find the
connected components of "similar":

1. Stars: each member is verified against one leader, the member of least rank
   of the blocks it shares with it most (where blocks hold sketches: the
   nearest of the leaders of its blocks that the sketches allow, and all of
   those of blocks of two).  The rank tells how far a member is
   from what others hold, so the original of a group of near copies leads it,
   and the group, however large, becomes one component with a number of pairs
   in proportion to its members.
2. Stars by sketch: members of blocks that are still in several components are
   verified against the nearest, by the sketches below, of some leads of their
   blocks, in a few rounds.
3. Crosses: only members of the same block that are still in different
   components can add anything.  In each block the members outside its largest
   component are paired with the members of other components, if the bounds
   allow it: sizes and sketches; these pairs are verified too.

A sketch is the parity of a set's items by hash bucket.  Common items cancel
out in the exclusive or of two sketches, so its bits are at most as many as
the items that only one set holds, and similar sets cannot differ in more than
the threshold allows for their sizes.

Pairs are verified by overlaps accumulated over parts of the columns: sets come
cut by hash range, a task multiplies one part of two rows, and the sums are
held against the bound that the sizes give.  The rows of a pair's second member
that very many pairs have (a leader of a large group) are dealt over several
tasks, as many as its measured number of pairs asks for.

No pair that could join two components is left out, so the components are
those of all links, though links inside a component need not be listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, if_small, written

#: Rows of a block, or pairs of a leader, that one task may get.
SHARE = 4096
#: Leads of a block in a round of stars by sketch, and such rounds.
LEADS = 32
ROUNDS = 2


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * |A & B| >= percent * |A | B| for sizes a and b."""
    return 100 * shared >= percent * (a + b - shared)


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b can be that similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bits(a: Column, b: Column, longs: int) -> Column:
    """Bits in which two sketches differ; a sketch may have fewer longs, as all of its block then have."""
    long = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit(0).cast("long"))
    return sum((F.bit_count(long(a, i).bitwiseXOR(long(b, i))) for i in range(longs)), F.lit(0))


def sketches_allow(a: Column, b: Column, na: Column, nb: Column, longs: int, percent: int) -> Column:
    """Whether sets with these sketches can be that similar: |A ^ B| (100 + percent) <= (100 - percent) (|A| + |B|)."""
    return _bits(a, b, longs) * (100 + percent) <= (100 - percent) * (na + nb)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by overlaps accumulated over the parts of the sets (node, part, n, items); n is the whole set's size."""
    pairs = written(pairs.select("a", "b"), "pairs")
    heavy = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > SHARE).select("b", F.ceil(F.col("times") / SHARE).cast("int").alias("shares")), "heavy")
    one = sets.select(F.col("node").alias("a"), "part", F.col("n").alias("na"), F.col("items").alias("items_a"))
    two = sets.select(F.col("node").alias("b"), "part", F.col("n").alias("nb"), F.col("items").alias("items_b"))
    key = ["b", "part"]
    if not heavy.isEmpty():
        heavy, key = if_small(heavy), [*key, "share"]
        shares = F.coalesce("shares", F.lit(1))
        pairs = pairs.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), shares).cast("int").alias("share"))
        two = two.join(heavy, "b", "left").select("b", "part", "nb", "items_b", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    product = pairs.join(one, "a").join(two, key).select("a", "b", "na", "nb", F.size(F.array_intersect("items_a", "items_b")).alias("shared"))
    overlap = product.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return overlap.where(similar(F.col("shared"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _unsettled(blocks: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of the blocks (block, node, n, rank, and a sketch if there is one) whose members are in several components,
    with each member's component, the block's main one, which holds most of its members, how many are outside it, and
    the number of shares to deal the block's rows in."""
    placed = written(blocks.join(first, "node", "left").select(*blocks.columns, F.coalesce("component", "node").alias("component")), "placed")
    per = placed.groupBy("block", "component").agg(F.count(F.lit(1)).alias("held"))
    main = per.groupBy("block").agg(F.max(F.struct("held", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("held").alias("members"))
    shares = F.ceil(F.col("members") / SHARE).cast("int").alias("shares")
    main = written(main.where("kinds > 1").select("block", F.col("top.component").alias("main"), (F.col("members") - F.col("top.held")).alias("outside"), shares), "mains")
    return written(placed.join(if_small(main), "block"), "mixed")


def _candidates(blocks: DataFrame, longs: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members and leaders of their blocks: the nearest that the sketches allow, and all
    such of blocks of two, if blocks have sketches, else for each member the leader that it shares most blocks with."""
    near = blocks.where((F.col("node") != F.col("lead")) & sizes_allow(F.col("n"), F.col("lead_n"), percent))
    if "sketch" in blocks.columns:
        allowed = near.where(sketches_allow(F.col("sketch"), F.col("lead_sketch"), F.col("n"), F.col("lead_n"), longs, percent))
        choice = F.min(F.struct(_bits(F.col("sketch"), F.col("lead_sketch"), longs).alias("bits"), "lead_rank", "lead"))
        nearest = allowed.where("size > 2").groupBy("node").agg(choice.alias("best")).select(F.col("node").alias("a"), F.col("best.lead").alias("b"))
        return nearest.union(allowed.where("size = 2").select("node", "lead")).distinct()
    counted = near.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("times"), F.min("lead_rank").alias("lead_rank"))
    best = counted.groupBy("node").agg(F.max_by("lead", F.struct("times", -F.col("lead_rank"), "lead")).alias("lead"))
    return best.select(F.col("node").alias("a"), F.col("lead").alias("b"))


def _nearest_leads(mixed: DataFrame, longs: int, percent: int, seed: int) -> DataFrame:
    """Pairs (a, b): each member outside the main component of a block, and of up to LEADS leads of
    each of its blocks the one with the nearest sketch that the bounds allow.

    The members of a block are dealt over LEADS and the one of least rank leads of each deal, so
    a block's leads are a bounded list and a member's choice stays one row of the join.
    """
    deal = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(LEADS))
    dealt = mixed.groupBy("block", deal.alias("deal")).agg(F.min(F.struct("rank", "node", "n", "component", "sketch")).alias("lead"), F.max("shares").alias("shares"))
    leads = dealt.groupBy("block").agg(F.collect_list("lead").alias("leads"), F.max("shares").alias("shares"))
    leads = leads.select("block", "leads", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def possible(x: Column) -> Column:
        return (x["component"] != F.col("component")) & sizes_allow(F.col("n"), x["n"], percent) & sketches_allow(F.col("sketch"), x["sketch"], F.col("n"), x["n"], longs, percent)

    def choice(x: Column) -> Column:
        return F.struct(_bits(F.col("sketch"), x["sketch"], longs).alias("bits"), x["node"].alias("lead"))

    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share")
    seeking = mixed.where("component <> main").select("block", "node", "n", "component", "sketch", own).join(leads, ["block", "share"])
    best = seeking.select("node", F.array_min(F.transform(F.filter("leads", possible), choice)).alias("best")).where("best is not null")
    return best.groupBy("node").agg(F.min("best").alias("best")).select(F.col("node").alias("a"), F.col("best.lead").alias("b"))


def linked_components(blocks: DataFrame, sketches: DataFrame | None, longs: int, percent: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (node, component) for the members with a link; blocks: (block,
    node, n, rank), n the set's size; sketches: (node, sketch), an array of so
    many longs.  Short sketches may stand in blocks instead; sketches is None then.

    verify keeps the similar ones of pairs (a, b).  blocks is read several
    times and should be a written table.
    """
    inline = sketches is None
    # blocks of one member say nothing
    lead = F.min(F.struct("rank", "node", "n", *(["sketch"] if inline else []))).alias("lead")
    heads = blocks.groupBy("block").agg(lead, F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    of_lead = [F.col("lead.rank").alias("lead_rank"), F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), *([F.col("lead.sketch").alias("lead_sketch")] if inline else [])]
    heads = written(heads.select("block", "size", *of_lead), "heads")
    blocks = written(blocks.join(if_small(heads), "block"), "blocks")
    stars = written(verify(_candidates(blocks, longs, percent)), "stars")
    first = written(components(stars), "star-components")
    # with sketches in blocks the members of blocks of two have met, so those are settled
    mixed = _unsettled((blocks.where("size > 2") if inline else blocks).select("block", "node", "n", "rank", *(["sketch"] if inline else [])), first)
    if mixed.isEmpty():
        return first
    if not inline:
        marked = written(sketches.join(if_small(written(mixed.select("node").distinct(), "mixed-nodes")), "node").dropDuplicates(["node"]), "sketches")
    for seed in range(ROUNDS):
        # with sketches in blocks, those with few members outside the main component go to the crosses at once
        large = mixed.where(F.col("outside") > LEADS) if inline else mixed
        if large.isEmpty():
            break
        more = verify(_nearest_leads(large if inline else large.join(marked, "node"), longs, percent, seed))
        stars = written(stars.unionByName(more), "stars")
        first = written(components(stars), "star-components")
        mixed = _unsettled(mixed.drop("component", "main", "outside", "shares"), first)
        if mixed.isEmpty():
            return first
    # the right side is dealt over the block's shares, the left one is small: what is outside the block's main component
    mixed = mixed if inline else mixed.join(marked, "node")
    left = mixed.where("component <> main").select("block", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("sketch").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = mixed.select("block", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("sketch").alias("sb"), (F.col("component") == F.col("main")).alias("in_main"), F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))
    apart = (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b")))
    possible = sizes_allow(F.col("na"), F.col("nb"), percent) & sketches_allow(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), longs, percent)
    crossing = left.join(right, ["block", "share"]).where(apart & possible)
    pairs = written(crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crosses")
    more = verify(pairs)
    return components(stars.unionByName(more))
