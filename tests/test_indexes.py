"""Block-max postings and vector lists against plain search; what they leave unread; inserts, tombstones, compaction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, search, vector_index
from lodestone.operators.vector_index import VectorIndex


def test_block_max_reads_few_blocks(spark, tmp_path):
    """700 documents: rich ones first, a rare word in three, two of them inside poor blocks; a thousand questions at once."""
    rng = random.Random(7)
    texts = []
    for i in range(1400):
        rich = i < 128
        texts.append((i, " ".join(["common"] * (12 if rich else 1) + ["medium"] * ((8 if rich else 1) if i % 3 == 0 else 0) + ["rare"] * 9 * (i in (5, 400, 690)) + [f"w{rng.randrange(60)}" for _ in range(10 if rich else 90)])))
    docs = spark.createDataFrame([*texts, (1400, None), (1401, "")], "doc_id long, text string")
    index.build(docs, f"file://{tmp_path}/index", block_docs=16)
    questions = [(q, t) for q in range(1000) for t in {"common", rng.choice(["medium", "rare", "absent"]), f"w{rng.randrange(60)}"}]
    asked = spark.createDataFrame([*questions, (7, None), (2000, "absent")], "question long, term string")
    found = index.block_max(spark, f"file://{tmp_path}/index", asked, 5)
    got = {}
    for r in found.top.collect():
        got.setdefault(r.question, []).append((r["rank"], r.doc_id, r.score))
    stored = spark.read.parquet(f"file://{tmp_path}/index/sizes")
    postings = search.postings(docs.where("text is not null"))
    for q in range(0, 1000, 53):
        words = [t for k, t in questions if k == q]
        plain = search.impacts(postings.where(F.col("term").isin(words)), stored).orderBy(F.desc("score"), "doc_id").limit(5).collect()
        assert sorted(got[q]) == [(i + 1, r.doc_id, r.score) for i, r in enumerate(plain)]
    assert len(got) == 1000 and 2000 not in got
    every, read = found.bounds.count(), found.read.count()
    assert read == found.read.distinct().count() and 3 * read < every


def test_index_of_nothing(spark, tmp_path):
    index.build(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "word")], "question long, term string")
    assert index.block_max(spark, f"file://{tmp_path}/index", asked).top.count() == 0


def nearest(vectors, query, k):
    """vectors: by id."""
    unit = {i: np.array(v, np.float32) / np.linalg.norm(np.array(v, np.float32)) for i, v in vectors.items()}
    scored = sorted((-round(float(unit[query] @ u), 6), i) for i, u in unit.items() if i != query)
    return [(i, -s) for s, i in scored[:k]]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16))
    return {i: (middle[i % 12] + 0.5 * rng.normal(size=16)).tolist() for i in range(1500)}


def test_vector_index(spark, tmp_path, vectors):
    schema = "vec_id long, embedding array<float>"
    odd = [(9000, None), (9001, [None] * 16), (9002, [float("nan")] * 16), (None, [1.0] * 16)]
    own = VectorIndex.create(spark.createDataFrame([*vectors.items(), *odd], schema), f"file://{tmp_path}/v", lists=24)
    asked = spark.createDataFrame([(i, v) for i, v in vectors.items() if i % 100 == 0], schema)
    points, usual = own.lists()
    assert len(points) == 24 and usual < 24
    assert own.recall(asked) >= 0.9

    def agree(held):
        got = {}
        for r in own.search(asked, 10, 24).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.cosine))
        for q in range(0, 1500, 100):
            plain = nearest(held | {q: vectors[q]}, q, 10)
            assert [c for _, _, c in sorted(got[q])] == pytest.approx([c for _, c in plain], abs=2e-6)
            assert len({i for _, i, _ in got[q]} & {i for i, _ in plain}) >= 9

    agree(vectors)
    more = {i: vectors[i % 1500] for i in range(2000, 2300)}
    own.insert(spark.createDataFrame(list(more.items()), schema))
    agree(vectors | more)
    dead = spark.createDataFrame([(i,) for i in range(2000, 2200)] + [(7,), (77_777,)], "vec_id long")
    own.remove(dead)
    left = {i: v for i, v in (vectors | more).items() if i != 7 and not 2000 <= i < 2200}
    agree(left)
    own.insert(spark.createDataFrame([(7, vectors[7])], schema))  # a dead id may come back
    own.insert(spark.createDataFrame([(2250, vectors[3])], schema), replace=True)
    left |= {7: vectors[7], 2250: vectors[3]}
    agree(left)
    before = own.rows().select("vec_id").toPandas().vec_id.tolist()
    own.compact()
    assert sorted(own.rows().select("vec_id").toPandas().vec_id) == sorted(before) == sorted(left)
    assert len(own._folders("segment")) == 1 and not own._folders("tombstones")
    agree(left)


def test_asking_vectors_are_not_broadcast_beyond_a_size(spark, tmp_path, vectors, monkeypatch):
    schema = "vec_id long, embedding array<float>"
    own = VectorIndex.create(spark.createDataFrame(list(vectors.items())[:300], schema), f"file://{tmp_path}/v", lists=8)
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(0, 300, 10)], schema)
    few = own.search(asked, 5, 8)
    monkeypatch.setattr(vector_index, "ASKED_BYTES", 0)
    many = own.search(asked, 5, 8)
    joins = ["BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
    assert joins == [True, False] and sorted(few.collect()) == sorted(many.collect())


def test_vector_index_of_nothing(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    own = VectorIndex.create(spark.createDataFrame([(1, None)], schema), f"file://{tmp_path}/v")
    assert own.search(spark.createDataFrame([(1, [1.0, 0.0])], schema)).count() == 0
    same = VectorIndex.create(spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], schema), f"file://{tmp_path}/same")
    got = same.search(spark.createDataFrame([(3, [1.0, 0.0])], schema), 4, len(same.lists()[0])).collect()
    assert [(r.vec_id, r.cosine) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1.0), (1, 1.0), (2, 1.0), (4, 1.0)]
