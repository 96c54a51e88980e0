"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source).  A token budget is passed down the tree
in proportion to the weights.  No node gets more than the tokens below it give
in the allowed epochs; what it cannot use goes to its siblings by their
weights, and only what all children of a node cannot use together leaves that
node for its own siblings.  Each leaf then takes whole epochs and, of one more
epoch, the prefix in a seeded order that its budget allows.

The order of an epoch is that of md5(seed:epoch:doc_id).  The end of a prefix
is found from sums of hashed parts of a leaf; rows are only ordered inside the
one part that the end falls into, so no task orders a hot leaf.  The result is
a small table of cut-offs, one row a leaf, against which every document is
held: texts are never shuffled.

Defined results: a null domain, language or source is the empty name; a null
or empty text has no tokens and goes with its place in the order; rows that
repeat an id stand at one place and are taken or left together; a leaf without
tokens gives nothing; an empty table gives an empty table.  Columns other than
doc_id, text, lang, source are passed on and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import if_small, written

SEED = 20
LEAF = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"

#: The production mixture: domains are four groups of sources; weights not named are 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "fr": 2, "de": 2, "es": 1}
EPOCHS = 2
SHARE = (6, 10)


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by their number."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0)) % 4).cast("string"))


def _weight(c: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(c) == name, w).otherwise(out)
    return out.cast("decimal(20,0)")


def _key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes with a column budget: each parent's column given, dealt to its
    children by weight up to their cap (water filling, whole tokens)."""
    over = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = over.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")), name)
    left = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: c.cast("decimal(38,0)")
    ranked = nodes.where("weight > 0").withColumn("_w", F.sum("weight").over(left)).withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    full = d(F.col("cap")) * d(F.col("_w")) <= d(F.col("weight")) * d(F.col("given") - F.col("_used"))
    ranked = ranked.withColumn("_full", full)
    kept = ranked.withColumn("_rest", d(F.col("given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(over), F.lit(0)))).withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(over))
    part = F.expr("cast(_rest as decimal(38,0)) * cast(weight as decimal(38,0)) div cast(_open as decimal(38,0))")
    return kept.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part).cast("long")).drop("_w", "_used", "_full", "_rest", "_open")


def budgets(leaves: DataFrame, total: Column | int, epochs: int, domains: dict[str, int], langs: dict[str, int], sources: dict[str, int] | None = None) -> DataFrame:
    """leaves (domain, lang, source, tokens) with each one's budget."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("given", F.lit(total).cast("long")).withColumn("weight", _weight("domain", domains))
    top = shared_out(top, [], "domain").select("domain", F.col("budget").alias("given"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain").withColumn("weight", _weight("lang", langs))
    mid = shared_out(mid, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    low = caps.join(mid, ["domain", "lang"]).withColumn("weight", _weight("source", sources or {}))
    return shared_out(low, ["domain", "lang"], "source").select(*LEAF, "tokens", "budget")


def placed(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), name("lang").alias("lang"), name("source").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    ).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "n_tokens")


def cutoffs(table: DataFrame, epochs: int, share: tuple[int, int], domains: dict[str, int], langs: dict[str, int], seed: int, sources: dict[str, int] | None = None) -> DataFrame:
    """A row a leaf: budget, whole epochs, and the last place (part, key, id) taken of the next one."""
    leaves = written(table.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    sums = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.max("rows"), F.lit(1)).alias("r")).first()
    planned = written(budgets(leaves.drop("rows"), sums["t"] * share[0] // share[1], epochs, domains, langs, sources).where("tokens > 0").withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens")), "budgets")
    # at least as many parts as rows in one, so that the sums and the one part put in order are both near the square root of a leaf
    width = 1
    while sums["r"] > 256**width:
        width += 1
    plan = planned.where("rest > 0")
    keyed = table.join(if_small(plan), LEAF).withColumn("key", _key(F.col("whole"), seed)).withColumn("part", F.substring("key", 1, width))
    parts = keyed.groupBy(*LEAF, "part", "rest").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy(*LEAF).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    edge = written(parts.where("before <= rest and before + tokens > rest").select(*LEAF, "part", "before"), "edges")
    inside = keyed.join(if_small(edge), [*LEAF, "part"])
    upto = Window.partitionBy(*LEAF, "part").orderBy("key", "doc_id")  # rows of one place count together
    last = inside.withColumn("sum", F.col("before") + F.sum("n_tokens").over(upto)).where("sum <= rest").groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    return written(
        planned.join(edge.select(*LEAF, F.col("part").alias("edge")), LEAF, "left").join(last, LEAF, "left").select(*LEAF, F.col("budget").alias("leaf_budget"), "whole", "rest", "edge", F.coalesce("last_key", F.lit("")).alias("last_key"), F.lit(width).alias("width")),
        "cutoffs",
    )


def chosen(docs: DataFrame, cuts: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (with the leaf's columns) once for each epoch they are taken in, with columns epoch and leaf_budget."""
    joined = docs.join(if_small(cuts), LEAF)
    key = _key(F.col("whole"), seed)
    part = F.substring(key, F.lit(1), F.col("width"))
    more = (F.col("rest") > 0) & (F.col("edge").isNotNull()) & ((part < F.col("edge")) | ((part == F.col("edge")) & (key <= F.col("last_key"))))
    times = F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")
    return joined.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("whole", "rest", "edge", "last_key", "width")


def mix(docs: DataFrame, epochs: int = EPOCHS, share: tuple[int, int] = SHARE, domains: dict[str, int] | None = None, langs: dict[str, int] | None = None, seed: int = SEED, sources: dict[str, int] | None = None) -> DataFrame:
    """Rows (doc_id, domain, lang, source, n_tokens, epoch, leaf_budget): every document in every epoch it is taken in."""
    table = written(placed(docs), "tokens")
    cuts = cutoffs(table, epochs, share, DOMAIN_WEIGHTS if domains is None else domains, LANG_WEIGHTS if langs is None else langs, seed, sources)
    return chosen(table, cuts, seed).select("doc_id", *LEAF, "n_tokens", F.col("epoch").cast("int").alias("epoch"), "leaf_budget")


def mixed_documents(docs: DataFrame, epochs: int = 1, share: tuple[int, int] = SHARE, seed: int = SEED) -> DataFrame:
    """The documents taken, with their own columns, a row for each epoch."""
    cuts = cutoffs(written(placed(docs), "tokens"), epochs, share, DOMAIN_WEIGHTS, LANG_WEIGHTS, seed)
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    led = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(name("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), whole.alias("row"))
    return chosen(led, cuts, seed).select("row.*")


def _fill(name: str, source: str, parent: str, child: str) -> str:
    """SQL for one level of water filling: source has parent columns, child, cap, given and weight."""
    over = f"PARTITION BY {parent}" if parent else ""
    order = f"{over} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {child}"
    return f"""{name}_a AS (
  SELECT *, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {source}
), {name}_b AS (SELECT *, CAST(cap AS HUGEINT) * CAST(w_left AS HUGEINT) <= CAST(weight AS HUGEINT) * CAST(given - used AS HUGEINT) AS is_full FROM {name}_a
), {name} AS (
  SELECT *, CASE WHEN is_full THEN CAST(cap AS HUGEINT) ELSE
    CAST(given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0) AS HUGEINT) * CAST(weight AS HUGEINT) // CAST(sum(CASE WHEN NOT is_full THEN weight END) OVER ({over}) AS HUGEINT) END AS budget
  FROM {name}_b
)"""


def _cases(c: str, weights: dict[str, int]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


ORACLE = rf"""
WITH n AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents
), t AS (
  SELECT *, 'd' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain FROM n
), leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {EPOCHS} AS cap FROM t GROUP BY ALL
), total AS (SELECT CAST(sum(tokens) AS HUGEINT) * {SHARE[0]} // {SHARE[1]} AS given FROM leaf
), d0 AS (SELECT domain, sum(cap) AS cap, any_value(given) AS given, {_cases("domain", DOMAIN_WEIGHTS)} AS weight FROM leaf, total GROUP BY domain
), {_fill("d1", "d0", "", "domain")}
, l0 AS (SELECT domain, lang, sum(leaf.cap) AS cap, any_value(d1.budget) AS given, {_cases("lang", LANG_WEIGHTS)} AS weight FROM leaf JOIN d1 USING (domain) GROUP BY domain, lang
), {_fill("l1", "l0", "domain", "lang")}
, s0 AS (SELECT domain, lang, source, tokens, leaf.cap, l1.budget AS given, 1 AS weight FROM leaf JOIN l1 USING (domain, lang)
), {_fill("s1", "s0", "domain, lang", "source")}
, plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS leaf_budget, CAST(budget // tokens AS BIGINT) AS whole, CAST(budget % tokens AS BIGINT) AS rest FROM s1 WHERE tokens > 0
), k AS (
  SELECT t.*, leaf_budget, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS upto
  FROM t JOIN plan USING (domain, lang, source)
), x AS (SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM k)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, leaf_budget FROM x
"""
