"""Typed conflicts: values, verdicts, ids that don't depend on the order, classes counted and not expanded."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conflicts
from lodestone.operators.conflicts import Rule

FACTS = "fact_id long, subject string, predicate string, object string, source string, active boolean, since long, until long"


def test_values(spark):
    said = [("1h", "dur:3600", None, None), ("60 min", "dur:3600", None, None), ("90 s", "dur:90", None, None), ("2 days", "dur:172800", None, None), ("1,500k USD", None, "d:1500000", None), ("$1.5m", None, "d:1500000", None), ("12.50", None, "d:12.5", None), ("-0.125", None, "d:-0.125", None),
            ("about five", None, None, None), ("2026-09-15", None, None, "dt:2026-09-15"), ("2026-9-15", None, None, None), ("03/04/26", None, None, None), ("2026-13-01", None, None, None), ("", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(s,) for s, *_ in said], "t string").select("t", conflicts.duration(F.col("t")), conflicts.plain_sum(F.col("t")), conflicts.iso_date(F.col("t")))
    assert [tuple(r) for r in df.collect()] == said


def kinds(spark, facts, rules=conflicts.RULES):
    signed = conflicts.signatures(spark.createDataFrame(facts, FACTS), rules)
    found = conflicts.conflicts(signed, 40)
    return {(r.a, r.b): r.kind for r in found.collect()}, {k: n for k, n in conflicts.verdict_counts(signed, found).items() if n}, {r.fact_id: r.standing for r in signed.collect()}


def test_verdicts(spark):
    city = lambda i, v, s, a, b, active=True: (i, "X", "city", v, s, active, a, b)
    assert kinds(spark, [city(1, "Lisbon", "d1", 0, 100), city(2, "Osaka", "d2", 50, 150)])[:2] == ({(1, 2): "proven_contradiction"}, {"proven_contradiction": 1})
    assert kinds(spark, [city(1, "Lisbon", "d1", 0, 40), city(2, "Osaka", "d2", 50, 150)])[:2] == ({}, {"historical_succession": 1})
    assert kinds(spark, [city(1, "Lisbon", "d1", None, None), city(2, "Osaka", "d2", None, None)])[0] == {(1, 2): "proven_contradiction"}
    assert kinds(spark, [city(1, "Lisbon", "d1", 100, 100), city(2, "Osaka", "d2", None, None)])[0] == {(1, 2): "candidate_review"}
    assert kinds(spark, [city(1, " lisbon  ", "d1", 0, 9), city(2, "LISBON", "d2", None, None)])[1] == {"agreement": 1}
    assert kinds(spark, [city(1, "Lisbon", "d1", 0, 9), city(2, "Osaka", "d1", 0, 9)])[1] == {}  # one source restating itself
    odd = [city(1, "Lisbon", "d1", 9, 0), city(2, "Osaka", "d2", 0, 9), city(3, "Rome", "d3", 0, 9, False), city(4, " ", "d4", 0, 9), (5, "X", "favorite color", "red", "d1", True, 1, 2), (6, "X", "favorite color", "blue", "d2", True, 1, 2)]
    assert kinds(spark, odd) == ({(5, 6): "candidate_review"}, {"candidate_review": 1}, {1: "malformed", 2: "projected", 3: "inactive", 4: "unparsed", 5: "unregistered", 6: "unregistered"})
    tags = (Rule("dim.test.tags", "tags", single=False, kind="text"),)
    assert kinds(spark, [(1, "x", "tags", "alpha", "d1", True, None, None), (2, "x", "tags", "beta", "d2", True, None, None)], tags)[1] == {"compatible_plurality": 1}
    money = [(1, "phoenix", "decision:budget_ceiling", "1,500k USD", "d1", True, 100, 100), (2, "phoenix", "decision:budget_ceiling", "$1.5m", "d2", True, 100, 100), (3, "altair", "decision:budget_ceiling", "$2m", "d3", True, 100, 100)]
    assert kinds(spark, money)[1] == {"agreement": 1}  # another key is no coordinate of theirs


def test_against_all_pairs_in_any_order(spark):
    rng = random.Random(3)
    facts = []
    for i in range(150):
        a = rng.choice([None, rng.randint(-200, 200)])
        facts.append((i, rng.choice(["x", "y"]), rng.choice(["city", "employer", "color"]), rng.choice("pqr"), rng.choice("stuv"), True, a, a if a is None else a + rng.randint(0, 120)))
    expected, counts = {}, {}
    for a, b in itertools.combinations(facts, 2):
        if a[1:3] != b[1:3] or a[4] == b[4]:
            continue
        known = a[2] != "color"
        kind = "agreement" if a[3] == b[3] else "candidate_review" if (a[6] is None) != (b[6] is None) else "historical_succession" if a[6] is not None and not (a[6] <= b[7] and b[6] <= a[7]) else "proven_contradiction" if known else "candidate_review"
        counts[kind] = counts.get(kind, 0) + 1
        if kind in ("candidate_review", "proven_contradiction"):
            expected[a[0], b[0]] = kind
    found, counted, _ = kinds(spark, facts)
    assert found == expected and counted == counts
    ids = lambda rows: sorted(r.pair_id for r in conflicts.conflicts(conflicts.signatures(spark.createDataFrame(rows, FACTS))).collect())
    renamed = [(1000 - f[0], *f[1:]) for f in reversed(facts)]
    assert ids(facts) == ids(renamed)


def test_nothing(spark):
    assert kinds(spark, [])[:2] == ({}, {})


@pytest.mark.parametrize("n", [400])
def test_agreement_is_not_expanded(spark, n):
    facts = [(i, "x", "city", "Lisbon", f"s{i}", True, i, i + 5) for i in range(n)]
    found, counts, _ = kinds(spark, facts)
    assert found == {} and counts == {"agreement": n * (n - 1) // 2}
