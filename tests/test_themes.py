"""Truncated SVD, latent vectors, random indexing and non-negative factors against numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import factors
from lodestone.operators.textvectors import Latent, Pooling, context_sums, context_vectors, contexts, weighted_sums


def table(spark, m):
    return spark.createDataFrame([(i, f"c{j}", float(x)) for i, row in enumerate(m) for j, x in enumerate(row) if x], "row long, col string, value double")


def test_truncated_svd(spark):
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(60, 5)) * [9, 5, 3, 1, 0.5]) @ rng.normal(size=(5, 25)) + 0.01 * rng.normal(size=(60, 25))
    found = factors.truncated_svd(table(spark, m), 4)
    u, s, v = np.linalg.svd(m, full_matrices=False)
    assert found.values == sorted(found.values, reverse=True) and found.values == pytest.approx(s[:4], rel=1e-8)
    left = {r["item"]: r.v for r in found.left.collect()}
    right = {r["item"]: r.v for r in found.right.collect()}
    for c in range(4):
        own, sign = np.array([left[i][c] for i in range(60)]), 1 if u[np.abs(u[:, c]).argmax(), c] > 0 else -1
        assert own[np.abs(own).argmax()] > 0
        assert np.allclose(own, sign * u[:, c], atol=1e-6)
        assert np.allclose([right[f"c{j}"][c] for j in range(25)], sign * v[c], atol=1e-6)


def test_svd_of_a_small_rank_and_of_nothing(spark):
    one = factors.truncated_svd(table(spark, np.outer([1, 2, 3], [1, 0, 2])), 3)
    assert one.values == pytest.approx([np.sqrt(14 * 5)]) and one.left.count() == 3
    assert factors.truncated_svd(table(spark, np.zeros((2, 2))), 3).values == []


DOCS = [(1, "cats chase mice and cats sleep"), (2, "dogs chase cats"), (3, "mice eat cheese"), (4, "stocks rise and bonds fall"), (5, "bonds and stocks trade"), (6, None), (7, " .. "), (8, "the rest")]


def test_latent_vectors(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    fitted = Latent.fit(docs, 3)
    assert 1 <= len(fitted.values) <= 3
    asked = spark.createDataFrame([*DOCS, (50, "unknown words only"), (51, "Cats! cats unknown")], "doc_id long, text string")
    got = {r.doc_id: np.array(r.v) for r in fitted.embed(asked).collect()}
    assert len(got) == len(DOCS) + 2 and not len(got[50]) and not len(got[6]) and not len(got[7])
    assert np.linalg.norm(got[51]) == pytest.approx(1)
    assert got[4] @ got[5] > 0.9 > abs(got[4] @ got[2])


def test_random_indexing_against_a_plain_sum(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b b"), (3, "x"), (4, None), (5, "")], "doc_id long, text string")
    expected = {}
    for text in ("a b c a b", "b b", "x"):
        ws = text.split()
        for i, w in enumerate(ws):
            for c in ws[max(0, i - 2) : i] + ws[i + 1 : i + 3]:
                for j in range(4):
                    digest = hashlib.md5(f"{j}:{c}".encode()).hexdigest()
                    key = (w, int(digest[:6], 16) % 16)
                    expected[key] = expected.get(key, 0) + 1 - 2 * (int(digest[6], 16) % 2)
    got = {(r.term, r.dim): r.value for r in context_vectors(contexts(docs), 16).collect()}
    assert got == {k: v for k, v in expected.items() if v}


def test_pooling_removes_the_mean_direction(spark):
    docs = spark.createDataFrame([*DOCS, (9, "cats cats mice mice"), (10, "mice cats")], "doc_id long, text string")
    fitted = Pooling.fit(docs, 16)
    got = {r.doc_id: r for r in fitted.pooled(docs).collect()}
    assert sum(x * x for x in fitted.mean.values()) == pytest.approx(1)
    for r in got.values():
        if r.v:
            assert sum(x * x for x in r.v.values()) == pytest.approx(1)
            assert sum(x * fitted.mean.get(d, 0) for d, x in r.v.items()) == pytest.approx(0, abs=1e-9)
    assert got[6].hits == got[7].hits == 0 and got[6].v is None
    assert got[9].v == pytest.approx(got[10].v) and got[9].hits == 2  # distinct words alone count


@pytest.mark.parametrize("method", ["multiply", "solve"])
def test_non_negative_factors(spark, method):
    rng = np.random.default_rng(4)
    m = rng.random((12, 2)) @ rng.random((2, 9))
    fit = factors.non_negative(table(spark, m), 2, 25, method=method)
    w = np.array([r.v for r in fit.rows.orderBy("item").collect()])
    h = np.array([r.v for r in fit.cols.orderBy("item").collect()])
    assert (w >= 0).all() and (h >= 0).all()
    assert fit.losses[-1] == pytest.approx(((m - w @ h.T) ** 2).sum(), abs=1e-9)
    assert fit.losses[-1] < 0.02 * (m**2).sum() and fit.losses[-1] < fit.losses[0]
    if method == "multiply":
        assert all(a >= b - 1e-9 for a, b in zip(fit.losses, fit.losses[1:], strict=False))


def test_themes_part_two_blocks(spark):
    pairs = [(a, b, 5) for group in ("abc", "xyz") for a in group for b in group if a < b] + [("a", "x", 0)]
    got = {r["item"]: r.theme for r in factors.themes(spark.createDataFrame(pairs, "a string, b string, weight long"), 2).collect()}
    assert len({got[x] for x in "abc"}) == len({got[x] for x in "xyz"}) == 1 and got["a"] != got["x"]
    assert factors.themes(spark.createDataFrame([], "a string, b string, weight long"), 2).agg(F.count(F.lit(1))).first()[0] == 0


@pytest.mark.parametrize("dimension", [16, 70])
def test_context_sums_leave_no_pairs_to_shuffle(spark, dimension):
    docs = spark.createDataFrame([*DOCS, (9, "a"), (10, "b b b"), (11, "é a é b")], "doc_id long, text string")
    found = context_sums(docs, dimension)
    plain = {(r.term, r.dim): r.value for r in context_vectors(contexts(docs), dimension).collect()}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.term, r.dim): r.value for r in found.collect()} == plain


def test_svd_over_head_and_tail(spark):
    """Whatever part of the columns is the head, two sweeps give the same."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < np.linspace(0.02, 0.6, 30))
    m[7, 2:] = 0
    entries = table(spark, m)
    plain, parted = (factors.truncated_svd(entries, 4, sweeps=2, head=head) for head in (100, 6))
    assert 0 < len(parted.head) <= 6 and len(plain.head) == len(set(np.nonzero(m)[1]))
    assert parted.values == pytest.approx(plain.values, rel=1e-10)
    for a, b in ((plain.left, parted.left), (plain.right, parted.right)):
        a, b = ({r["item"]: r.v for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_svd_shuffles_no_rows_of_the_table(spark):
    m = factors.matrix_of(table(spark, np.ones((30, 4))))
    side = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(30)], "item long, v array<double>").hint("merge")
    for plan in (factors.over(m, np.ones((4, 2)), side), factors.back(m, side, 2)):
        tree = plan._jdf.queryExecution().executedPlan().toString()
        assert "ids" not in "".join(x for x in tree.splitlines() if "Exchange" in x) and tree.count("Exchange hashpartitioning(row") == 1


@pytest.mark.parametrize("head", [0, 4, 100])
def test_weighted_sums(spark, head):
    """Rows of one id are one document; each row counts for a word's frequency."""
    rows = [*DOCS, (1, "cats and cats"), (1, None), (3, ""), (12, "é é e"), (13, "cheese")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = [(i, [w.lower() for w in t.replace(".", " ").split()]) for i, t in rows if t is not None]
    df = Counter(w for _, ws in words for w in set(ws))
    tf = Counter((i, w) for i, ws in words for w in ws)
    expected = {}
    for (i, w), n in tf.items():
        x = n * max(0.0, np.log((len(words) + 1) / (df[w] + 1)))
        a, b, c = expected.get(i, (0, 0.0, 0.0))
        expected[i] = (a + 1, b + x, c + x * x)
    got = {r.doc_id: (r.terms, r.weight, r.squares) for r in weighted_sums(docs, head).collect()}
    assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i]) for i in got)
    assert got == {r.doc_id: pytest.approx((r.terms, r.weight, r.squares)) for r in weighted_sums(docs.repartition(3), head).collect()}


def test_latent_vectors_do_not_hang_on_the_head(spark):
    docs = spark.createDataFrame([*DOCS, (9, "cats chase mice"), (9, "dogs")], "doc_id long, text string")
    plain, parted = (Latent.fit(docs, 3, 2, most) for most in (100, 3))
    assert parted.values == pytest.approx(plain.values)
    of = lambda x: {r.doc_id: r.v for r in x.embed(docs).collect()}
    a, b = of(plain), of(parted)
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-6) for i in (1, 2, 9)), (a, b)  # a text outside of the space has a direction by rounding alone
