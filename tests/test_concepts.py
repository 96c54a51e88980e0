"""Concepts and implications against plain set algebra."""

import random
from itertools import combinations

import pytest

from lodestone.operators import concepts as fca

COHORTS = [["red", "large"]] * 3 + [["blue", "small"]] * 2 + [["round"]]
BRIDGE = [["a", "b"], ["a", "b"], ["a", "c"], ["b", "c"]]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, items array<string>")


def asking(spark, intents):
    return spark.createDataFrame([(list(x),) for x in intents], "intent array<string>")


def closed(rows, attributes):
    sets = [set(r or ()) - {None} for r in rows]
    universe = set().union(*sets) if sets else set()
    extent = [s for s in sets if set(attributes) <= s]
    return len(extent), frozenset(universe.intersection(*extent) if extent else universe)


def all_concepts(rows, least, largest):
    universe = sorted(set().union(*(set(r or ()) - {None} for r in rows)))
    out = {}
    for k in range(1, len(universe) + 1):
        for s in combinations(universe, k):
            n, c = closed(rows, s)
            if n >= least and len(c) <= largest:
                out[c] = n
    return out


def basis(rows, largest):
    universe = sorted(set().union(*(set(r or ()) - {None} for r in rows)))
    out = {}
    for k in range(min(largest, len(universe)) + 1):
        for s in map(frozenset, combinations(universe, k)):
            n, c = closed(rows, s)
            if c != s and all(d <= s for q, (d, _) in out.items() if q < s):
                out[s] = (c, n)
    return {(s, c - s, n) for s, (c, n) in out.items()}


def mined(spark, rows, *bounds):
    out = fca.concepts(fca.context(frame(spark, rows)), *bounds).collect()
    assert len(out) == len({tuple(r.intent) for r in out}) and all(r.intent == sorted(r.intent) for r in out)
    return {frozenset(r.intent): r.support for r in out}


def implied(spark, rows, largest=100):
    out = fca.implications(fca.context(frame(spark, rows)), largest).collect()
    assert len(out) == len({tuple(r.premise) for r in out})
    return {(frozenset(r.premise), frozenset(r.conclusion), r.support) for r in out}


def test_derivations(spark):
    rows = [*COHORTS, None, ["red", None, "red"]]
    asked = [[], ["green"], ["red"], ["large", "red"], ["blue", "red"], ["round"]]
    got = fca.extents(frame(spark, rows), "id", asking(spark, asked)).collect()
    by = {tuple(a): sorted(r.id for r in got if r.intent == a) for a in asked}
    assert by[()] == list(range(8)) and by[("green",)] == [] and by[("red",)] == [0, 1, 2, 7] and by[("large", "red")] == [0, 1, 2] and by[("blue", "red")] == []
    ctx = fca.context(frame(spark, rows))
    for r in fca.closures(ctx, asking(spark, asked)).collect():
        assert (r.extent, frozenset(r.closed)) == closed(rows, r.intent) and r.closed == sorted(r.closed)
    members = spark.createDataFrame([("cohort", 0), ("cohort", 1), ("mixed", 0), ("mixed", 3), ("none", None), ("bare", 6)], "part string, id long")
    got = {r.part: r.intent for r in fca.shared(frame(spark, rows), "id", members).collect()}
    assert got == {"cohort": ["large", "red"], "mixed": [], "none": ["blue", "large", "red", "round", "small"], "bare": []}


def test_closure_is_idempotent(spark):
    ctx = fca.context(frame(spark, COHORTS))
    once = fca.closures(ctx, asking(spark, [["red"], ["round"], [], ["red", "blue"]])).select("closed").collect()
    again = fca.closures(ctx, asking(spark, [r.closed for r in once])).collect()
    assert again and all(r.intent == r.closed for r in again)


def test_concepts_of_cohorts(spark):
    assert mined(spark, COHORTS, 2) == {frozenset({"large", "red"}): 3, frozenset({"blue", "small"}): 2}
    assert mined(spark, COHORTS, 3) == {frozenset({"large", "red"}): 3}
    assert mined(spark, COHORTS, 4) == {}
    assert len(mined(spark, COHORTS, 0)) == 3  # a support of 0 counts as 1
    assert mined(spark, [["a", "b"]] * 3 + [["a"]] * 2, 2, 1) == {frozenset("a"): 5}
    assert mined(spark, COHORTS, 2, 0) == {} and mined(spark, [], 1) == {} and mined(spark, [None, []], 1) == {}


def test_seeds_of_two_find_more(spark):
    assert set(mined(spark, BRIDGE, 2, 8, 1)) == {frozenset("a"), frozenset("b"), frozenset("c")}
    assert set(mined(spark, BRIDGE, 2, 8, 2)) == {frozenset("a"), frozenset("b"), frozenset("c"), frozenset("ab")}


def test_random_context(spark):
    rng = random.Random(1)
    rows = [[x for x in "abcdefg" if rng.random() < 0.55] for _ in range(14)] + [["a", "b", "c"]] * 3
    assert mined(spark, rows, 2, 8) == all_concepts(rows, 2, 8)
    assert mined(spark, rows, 1, 3) == all_concepts(rows, 1, 3)
    assert implied(spark, rows, 3) == basis(rows, 3)


@pytest.mark.parametrize("rows, premises", [
    ([["a", "b"], ["b", "c"]], [""]),
    ([["a", "b"], ["c", "d"]], ["a", "b", "c", "d"]),
    ([["a"], ["b"], ["c"]], ["ab", "ac", "bc"]),
])
def test_small_bases(spark, rows, premises):
    got = implied(spark, rows, 3)
    assert got == basis(rows, 3)
    # of the whole basis, what the fixtures name; larger sets that no row holds follow from them or are listed too
    assert {frozenset(p) for p in premises} <= {p for p, _, _ in got}


def test_bases_at_the_edges(spark):
    assert implied(spark, [["a"], ["b"], ["c"]], 1) == set()
    assert implied(spark, [["a"], ["b", "c"]], 1) == {(frozenset("b"), frozenset("c"), 1), (frozenset("c"), frozenset("b"), 1)}
    assert implied(spark, [], 1) == set() and implied(spark, [None], 1) == set()
    assert implied(spark, [["a"], ["a"]], 1) == {(frozenset(), frozenset("a"), 2)}
