"""Typed conflicts: facts become signatures, signatures meet on their coordinate, pairs get a verdict.

A coordinate is a key (whom a fact is about) and a dimension (what it says).
Pairs of one value agree and are kept as classes, never expanded.  Pairs of
different values are only formed where their times overlap, by an interval
join over time buckets, or where a time is unknown; pairs apart in time are
counted from class sizes.  So the rows grow with the conflicts, not with the
square of a coordinate's facts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import written

#: Seconds of a time bucket of the overlap join.
BUCKET = 30 * 86_400
#: Seconds of the units of a duration, factors of a sum's suffix.
SECONDS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86_400, "day": 86_400}
FACTORS = {"k": 1_000, "m": 1_000_000}


@dataclass(frozen=True)
class Rule:
    """How a dimension is read: its id (dim.<domain>.<name>), whether one value holds at a time, and the type of its values."""

    rule_id: str
    dimension: str
    single: bool = True
    kind: str = "token"

    @property
    def domain(self) -> str:
        return self.rule_id.split(".")[1] if self.rule_id.count(".") else "unknown"


#: The first registry.
RULES = (Rule("dim.person.employer", "employer"), Rule("dim.person.city", "city"), Rule("dim.decision.budget_ceiling", "decision:budget_ceiling", kind="sum"), Rule("dim.decision.launch_date", "decision:launch_date", kind="date"))


# --- values ---------------------------------------------------------------------------------------------------------------


def collapsed(text: Column) -> Column:
    """White space at the ends gone, else one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token(text: Column) -> Column:
    return F.lower(collapsed(text))


def duration(text: Column) -> Column:
    """dur:<seconds> of a whole number and a unit, else null."""
    parts = [F.regexp_extract(token(text), r"^(\d{1,12}) ?([a-z]+?)s?$", i) for i in (1, 2)]
    unit = F.create_map(*(F.lit(x) for pair in SECONDS.items() for x in pair))
    seconds = F.try_element_at(unit, F.when(token(text) == F.concat(parts[0], F.lit("s")), F.lit("s")).otherwise(parts[1]))
    return F.when(parts[0] != "", F.concat(F.lit("dur:"), (F.expr("1L") * F.nullif(parts[0], F.lit("")).cast("long") * seconds).cast("string")))


def plain_sum(text: Column) -> Column:
    """d:<decimal> of an amount in dollars with thousands commas and a suffix k or m, without trailing zeros; else null."""
    found = [F.regexp_extract(token(text), r"^\$?(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d{1,18}(?:\.\d+)?) ?([km]?)(?: ?usd)?$", i) for i in (1, 2)]
    factor = reduce(lambda c, kv: c.when(found[1] == kv[0], F.lit(kv[1])), FACTORS.items(), F.when(found[1] == "", F.lit(1)))
    amount = F.nullif(F.regexp_replace(found[0], ",", ""), F.lit("")).cast("decimal(24,6)") * factor.cast("decimal(7,0)")
    return F.concat(F.lit("d:"), F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def iso_date(text: Column) -> Column:
    """dt:<date> of a full ISO date that exists, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t).isNotNull(), F.concat(F.lit("dt:"), t))


def canonical(rule: Rule, text: Column) -> Column:
    kinds = {"token": lambda: F.when(token(text) != "", F.concat(F.lit(f"e:{rule.rule_id}#"), token(text))), "sum": lambda: plain_sum(text), "date": lambda: iso_date(text), "duration": lambda: duration(text), "text": lambda: F.concat(F.lit("s:"), collapsed(text))}
    return kinds[rule.kind]()


# --- signatures -----------------------------------------------------------------------------------------------------------


def signatures(facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """fact_id, standing, key, dimension, value, single, source, since, until of facts (fact_id, subject, predicate, object, source, active, since, until).

    standing: projected, inactive, unparsed, malformed (since after until) or
    unregistered (no rule: such facts keep their text as value, and single is
    null).  since and until are seconds, both null where the time is unknown.
    """
    name = token(F.col("predicate"))
    pick = lambda f, other: reduce(lambda c, r: c.when(name == r.dimension, f(r)), rules, F.when(F.lit(False), other)).otherwise(other)
    value = pick(lambda r: canonical(r, F.col("object")), F.concat(F.lit("s:"), collapsed(F.col("object"))))
    known = name.isin([r.dimension for r in rules])
    standing = F.when(~F.coalesce("active", F.lit(False)), "inactive").when(F.col("since") > F.col("until"), "malformed").when(value.isNull(), "unparsed").when(~known, "unregistered").otherwise("projected")
    single = pick(lambda r: F.lit(r.single), F.lit(None).cast("boolean"))
    timed = F.col("since").isNotNull() & F.col("until").isNotNull()
    return facts.select("fact_id", standing.alias("standing"), F.concat(pick(lambda r: F.lit(r.domain), F.lit("unknown")), F.lit(":"), token(F.col("subject"))).alias("key"), name.alias("dimension"), value.alias("value"), single.alias("single"), "source", F.when(timed, F.col("since")).alias("since"), F.when(timed, F.col("until")).alias("until"))


def signature_id(s: str = "") -> Column:
    """A digest of what a signature says; the same whatever order facts come in."""
    c = lambda x: F.coalesce(F.col(f"{s}{x}").cast("string"), F.lit("?"))
    return F.sha2(F.concat_ws("\n", c("key"), c("dimension"), c("value"), c("source"), c("since"), c("until")), 256)


# --- verdicts -------------------------------------------------------------------------------------------------------------


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = ["fact_id", "value", "source", "since", "until"]
    return df.withColumnsRenamed({c: f"a_{c}" for c in cols}), df.withColumnsRenamed({c: f"b_{c}" for c in cols})


def conflicts(signed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """key, dimension, a, b, kind, pair_id: pairs of different values and sources (a < b) that contradict or need a review.

    kind: proven_contradiction (times overlap, or both are unknown) or
    candidate_review (one time is unknown, or the dimension has no rule).
    """
    live = written(signed.where("standing IN ('projected', 'unregistered') AND coalesce(not single, false) = false").withColumn("sid", signature_id()), "signatures")
    cols = ["key", "dimension", "fact_id", "value", "source", "since", "until", "single", "sid"]
    timed = live.where("since is not null").select(*cols)
    held = F.sequence(F.floor(F.col("since") / bucket), F.floor(F.col("until") / bucket))
    spread = timed.withColumn("bucket", F.explode(held))
    names = {c: f"b_{c}" for c in ("fact_id", "value", "source", "since", "until", "single", "sid")}
    differ = (F.col("value") != F.col("b_value")) & (~F.col("source").eqNullSafe(F.col("b_source")) | F.col("source").isNull()) & (F.col("fact_id") < F.col("b_fact_id"))
    overlap = (F.col("since") <= F.col("b_until")) & (F.col("b_since") <= F.col("until"))
    first = F.col("bucket") == F.floor(F.greatest("since", "b_since") / bucket)  # a pair meets in one of its buckets
    met = spread.join(spread.withColumnsRenamed(names), ["key", "dimension", "bucket"]).where(differ & overlap & first).drop("bucket")
    loose = live.where("since is null").select(*cols)
    every = live.select(*cols).withColumnsRenamed(names)
    once = F.when(F.col("b_since").isNull(), F.col("fact_id") < F.col("b_fact_id")).otherwise(F.lit(True))
    apart = loose.join(every, ["key", "dimension"]).where((F.col("value") != F.col("b_value")) & (~F.col("source").eqNullSafe(F.col("b_source")) | F.col("source").isNull()) & once)
    both = met.unionByName(apart)
    kind = F.when(F.col("single").isNull() | F.col("b_single").isNull() | (F.col("since").isNull() != F.col("b_since").isNull()), "candidate_review").otherwise("proven_contradiction")
    pair = F.sha2(F.concat_ws("\n", F.least("sid", "b_sid"), F.greatest("sid", "b_sid"), kind), 256)
    return both.select("key", "dimension", F.least("fact_id", "b_fact_id").alias("a"), F.greatest("fact_id", "b_fact_id").alias("b"), kind.alias("kind"), pair.alias("pair_id"))


def _pairs(df: DataFrame, *by: str) -> Column | int:
    """Unordered pairs inside the groups of by."""
    return df.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long")).first()[0]


def verdict_counts(signed: DataFrame, found: DataFrame) -> dict[str, int]:
    """How many pairs of different sources have each verdict; all pairs of a coordinate are counted, none is formed beyond found (of conflicts())."""
    classes = written(signed.where("standing IN ('projected', 'unregistered')").groupBy("key", "dimension", "single", "value", "source").agg(F.count(F.lit(1)).alias("n")), "classes")
    place = ("key", "dimension", "single")
    apart = lambda df, *by: _pairs(df, *place, *by) - _pairs(df.where("source is not null"), *place, *by, "source")
    out = {"agreement": apart(classes, "value")}
    plural = classes.where("not single")
    out["compatible_plurality"] = apart(plural) - apart(plural, "value")
    out |= {"proven_contradiction": 0, "candidate_review": 0} | {r.kind: r.n for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    out["historical_succession"] = apart(classes) - sum(out.values())
    return out


def agreements(signed: DataFrame) -> DataFrame:
    """key, dimension, value, facts, sources of the values that more than one source gives."""
    held = signed.where("standing IN ('projected', 'unregistered')").groupBy("key", "dimension", "value", "source").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("key", "dimension", "value").agg(F.sum("n").alias("facts"), F.count(F.lit(1)).alias("sources")).where("sources > 1")
