"""Closures, communities and summaries against plain walks and numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import closure, communities, mining, signals


def reached(edges):
    out = set()
    for start in {a for a, _ in edges}:
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(start, x) for x in seen if x != start}
    return out


def test_closure_and_its_increment(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(20)] + [(20, 3), (5, 5)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(12)]
    schema = "child long, parent long"
    assert {tuple(r) for r in closure.ancestors(spark.createDataFrame(edges, schema)).collect()} == reached(edges)
    old, new = edges[::2], [*edges[1::2], (3, 3)]
    stored = closure.ancestors(spark.createDataFrame(old, schema))
    added = closure.extended(stored, spark.createDataFrame(new, schema)).collect()
    assert len(added) == len({tuple(r) for r in added})
    assert {tuple(r) for r in added} == reached(edges) - reached(old)
    assert closure.ancestors(spark.createDataFrame([], schema)).count() == 0


def test_communities(spark):
    groups = ["abcd", "wxyz"]
    edges = [(a, b, 2.0) for g in groups for a in g for b in g if a < b] + [("d", "w", 1.0), ("p", "q", 3.0), ("a", "a", 9.0), ("q", "z", 0.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    labels = communities.propagated(df)
    got = {r.node: r.community for r in labels.collect()}
    assert got == {x: g[0] for g in groups for x in g} | {"p": "p", "q": "p"}
    assert {r.node: r.community for r in communities.propagated(df.repartition(7)).collect()} == got
    whole = sum(w for a, b, w in edges if a != b)
    inside, ends = 0.0, Counter()
    for a, b, w in edges:
        if a != b and w:
            inside += w * (got[a] == got[b])
            ends[got[a]] += w
            ends[got[b]] += w
    assert communities.modularity(df, labels) == pytest.approx(inside / whole - sum(x * x for x in ends.values()) / (2 * whole) ** 2)
    top = communities.dominant(df.where("a <> b"), labels).first()
    assert (top.community, top.nodes, top.weight) == ("a", 4, 12.0)


def central(sents, n):
    words = [Counter(w for w in re.findall(r"[a-z0-9]+", s.lower()) if len(w) > 1) for s in sents]
    m = np.eye(len(sents))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i != j and a and b:
                c = sum(a[w] * b[w] for w in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                m[i, j] = c if c >= 0.1 else 0
    x = np.ones(len(sents))
    for _ in range(24):
        x = m @ x
        x /= np.linalg.norm(x)
    return sorted(sorted(range(len(sents)), key=lambda i: (-round(x[i], 6), i))[:n])


def test_lexrank(spark):
    rng = random.Random(9)
    docs = {i: [" ".join(rng.choices(["cat", "dog", "mouse", "bird", "fish", "tree", "sun", "rain"], k=rng.randint(2, 9))).capitalize() + "." for _ in range(rng.randint(1, 9))] for i in range(6)}
    docs[6] = ["Alpha beta.", "Gamma delta!", "Epsilon zeta?", "Eta theta"]
    rows = [(i, " ".join(s)) for i, s in docs.items()] + [(10, None), (11, ""), (12, " \n ")]
    got = {}
    for r in communities.lexrank(spark.createDataFrame(rows, "doc_id long, text string"), 3).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.sentence))
    assert got == {i: [(k, s[k]) for k in central(s, 3)] for i, s in docs.items()}


def test_lexrank_in_rows_and_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(" ".join(rng.choices("abc bcd cde def efg fgh ghi x".split(), k=rng.randint(1, 5))) + "." for _ in range(rng.randint(1, 12)))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    took = []
    rounds = communities._ranked_in_rounds
    monkeypatch.setattr(communities, "_ranked_in_rounds", lambda *a: took.append(1) or rounds(*a))
    key = lambda df: sorted((r.doc_id, r.place, r.sentence, round(r.score, 6)) for r in df.collect())
    whole = key(communities.lexrank(docs, 3))
    assert not took
    monkeypatch.setattr(communities, "ROW_SENTENCES", 4)
    assert key(communities.lexrank(docs, 3)) == whole and took


def test_rounds_over_an_adjacency(spark):
    rows = [(1, 5), (1, 6), (1, 6), (2, 6), (2, 7), (2, None), (None, 5), (None, 7), (3, 8), (4, 5), (4, 6), (4, 7)]
    edges = mining.sharing(spark.createDataFrame(rows, "g long, n long"), "g", "n")
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # rows once, pairs once
    assert sorted(map(tuple, edges.collect())) == [(5, 6), (5, 7), (6, 5), (6, 7), (7, 5), (7, 6)]
    one_way = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long")
    near = mining.adjacency(one_way)
    m = np.eye(4)
    for a, b in ((0, 1), (0, 2), (1, 2), (2, 3)):
        m[b, a] = 1
    x = np.ones(4)
    for _ in range(3):
        x = m @ x / np.linalg.norm(m @ x)
    got = {r.id: r.x for r in mining.eigenvector(near, 3).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == pytest.approx(x)
    walked = {r.id: r.mass for r in signals.restart_walk(near, spark.createDataFrame([(1,)], "id long"), 2).collect()}
    assert walked == pytest.approx({1: 0.15, 2: 0.06375, 3: 0.425, 4: 0.36125})


def test_itemsets_are_counted_from_combinations(spark):
    from itertools import combinations

    rng = random.Random(6)
    rows = [tuple(rng.choice(["x", "y", "z", None, str(rng.randrange(50))]) for _ in range(4)) for _ in range(300)] + [(None,) * 4] * 20
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    want = Counter()
    for r in rows:
        held = sorted(f"{c}:{x}" for c, x in zip("abcd", r) if x is not None)
        want.update(s for k in (1, 2, 3) for s in combinations(held, k))
    sets, total = mining.frequent_itemsets(df, list("abcd"), 0.01)
    assert total == 320 and {tuple(r["items"]): r.freq for r in sets.collect()} == {s: n for s, n in want.items() if n >= 4}
    found = mining.itemset_rules(df, list("abcd"), 0.01).collect()
    assert len(found) == sum(len(s) for s, n in want.items() if n >= 4 and len(s) > 1)
    r = next(r for r in found if "&" in r.antecedent)
    both = tuple(sorted([*r.antecedent.split("&"), r.consequent]))
    assert r.support == want[both] / 320 and r.confidence == pytest.approx(want[both] / want[tuple(r.antecedent.split("&"))])


@pytest.mark.parametrize("carried", [64, 2])
def test_subject_edges_are_made_once(spark, carried):
    rng = random.Random(carried)
    some = lambda n: rng.choice([None, *range(n)])
    rows = [(some(40), some(8), some(40)) for _ in range(300)]
    first = {}
    for r, s, _ in rows:
        if r is not None and s is not None:
            first.setdefault(s, set()).add(r)
    want = {(min(r, x), max(r, x)) for r, _, x in rows if None not in (r, x) and r != x}
    want |= {(a, b) for held in first.values() for a in sorted(held)[:20] for b in sorted(held)[:20] if a < b}
    edges = mining.subject_edges(spark.createDataFrame(rows, "r long, s long, t long"), "r", "s", "t", 20, carried)
    got = sorted(map(tuple, edges.collect()))
    assert got == sorted(want)


def test_closures_are_not_broadcast(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "node long, ancestor long")
    plan = closure._composed(pairs, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
