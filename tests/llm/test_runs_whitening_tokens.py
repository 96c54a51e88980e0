"""Periodic runs, whitening and token files against brute force and exact round trips."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import periodic, token_files, whitening

SCHEMA = "doc_id long, text string, runs int, start int, tie string, n int"


def periodic_words(seed):
    """Words with repeats of every kind: of parts, of single words, of nothing."""
    rng, w, n = random.Random(seed), [], random.Random(-seed).randint(0, 400)
    letters = rng.choice([1, 2, 3, 5, 50])
    while len(w) < n:
        kind = rng.random()
        if kind < 0.5 and w:
            s = rng.randrange(len(w))
            w += w[s : s + rng.randint(1, 60)] * rng.randint(1, 6)
        elif kind < 0.7:
            w += [rng.randrange(letters)] * rng.randint(1, 40)
        else:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
    return w[:n]


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        t = 0
        while t + q < n:
            s = t
            while t + q < n and w[t] == w[t + q]:
                t += 1
            x = w[s : t + q]
            if len(x) >= max(24, 3 * q) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((s, len(x), q))
            t += t == s
    return sorted(out)


@pytest.mark.parametrize(("window", "digits"), [(periodic.WINDOW, periodic.DIGITS), (64, 4)])
def test_runs_against_all_periods(monkeypatch, window, digits):
    monkeypatch.setattr(periodic, "WINDOW", window)
    monkeypatch.setattr(periodic, "DIGITS", digits)
    found = 0
    for period in (16, 40, 64):  # copies of blocks are aligned blocks themselves
        w = [-i for i in range(1, 21)] + [*range(period)] * 4 + [-i for i in range(1, 31)]
        assert periodic.runs_of(np.array(w, np.int64) + 50) == [(20, 4 * period, period)]
    for seed in range(250):
        w = periodic_words(seed)
        expected = brute_runs(w)
        assert periodic.runs_of(np.array(w, np.int64)) == expected
        found += len(expected)
    assert found > 300


def test_runs_of_long_texts():
    rng = np.random.default_rng(1)
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    w = np.concatenate((rng.integers(0, 9000, 5000), np.tile(rng.integers(0, 9000, 30_000), 4)[:100_000], rng.integers(0, 9000, 5000)))
    (run,) = periodic.runs_of(w)
    assert run[2] == 30_000 and run[1] >= 100_000


def expected_digest(doc_id, text):
    words = periodic.rotated(doc_id, (text or "").encode().split())
    assert doc_id is None or len(words) == len((text or "").encode().split())
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_run_query(spark):
    texts = [(None, "a b " * 30), (1, None), (2, ""), (3, " \n\t"), (4, "a b c " * 9 + "x"), (5, "w " * 24), (6, "w " * 23), (4, "a b c " * 9 + "x"), (7, "é ñ o " * 20)]
    texts += [(i, " ".join(f"w{x}" for x in periodic_words(i))) for i in range(100, 160)]
    rows = [(i, t, 1, 2, "t", 3) for i, t in texts]
    got = periodic.digests(periodic.found(spark.createDataFrame(rows, SCHEMA), periodic.rotated)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *expected_digest(i, t))) for i, t in texts)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts) >= 4
    assert periodic.digests(periodic.found(spark.createDataFrame([], SCHEMA))).count() == 0


def test_rotation():
    assert periodic.rotated(1, []) == []
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [b"%d" % k for k in range(200)]
    g = zlib.crc32(str(i).encode()) // 10
    a = g % 200
    p = 1 + (200 - a) // (3 + g % 8)
    assert periodic.rotated(i, words) == [words[k] if k < a else words[a + (k - a) % p] for k in range(200)]


# --- whitening ------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, n long, component int"


def exact(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(len(x) * c - s, len(x))) for c, s in zip(r, sums, strict=True)] for r in x])
    cov = [[Fraction(sum((len(x) * r[i] - sums[i]) * (len(x) * r[j] - sums[j]) for r in x), len(x) ** 3) for j in range(len(sums))] for i in range(len(sums))]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    return [sum((len(x) * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x], centred, values[::-1], axes[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(0.3, 0.02, 12)) + 0.5).astype(np.float32).tolist()
    vectors[7] = vectors[8]
    odd = [(900, None, 1, 1), (901, [], 1, 1), (902, [None] * 12, 1, 1), (903, [float("nan")] * 12, 1, 1), (904, [float("inf"), *[0.0] * 11], 1, 1)]
    rows = [(i if i != 3 else None, v, 1, 1) for i, v in enumerate(vectors)] + odd
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(7)).collect()
    assert len(got) == 8 * len(vectors)
    deviation, centred, values, axes = exact(vectors)
    of = {(3 if r.vec_id is None else r.vec_id, r.component): r for r in got}
    for c in range(1, 9):
        white = np.array([of[i, c].whitened for i in range(300)])
        plain = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        assert np.allclose(white, plain, atol=1e-9) or np.allclose(white, -plain, atol=1e-9)
        assert of[0, c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert all(of[i, 1].deviation == deviation[i] and of[i, 1].n == 300 for i in range(300))
    assert got[0].identity_error < 1e-9


def test_chan_merge_equals_one_pass():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(1000, 5)) * 100)
    parts = [whitening.Moments.of(p, True) for p in np.split(x, [1, 10, 700])]
    one, tree = whitening.Moments.of(x, True), parts[3].merge(parts[0]).merge(parts[2].merge(parts[1]))
    assert tree.n == 1000 and tree.sums == one.sums and np.allclose(tree.mean, one.mean) and np.allclose(tree.scatter, one.scatter, rtol=1e-12)


def test_whitening_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(5, [1.0, 2.0], 1, 1)], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 1, 1) for i in range(4)] + [(9, [1.0], 1, 1)], VECTORS)).collect()
    assert {(r.component, r.n, r.explained) for r in flat} == {(1, 4, 1.0), (2, 4, 0.0), (1, 1, None)}
    assert all((r.whitened is None) == (r.component == 2 or r.n == 1) for r in flat)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    large = whitening.whiten(spark.createDataFrame([(i, [1e30 * (i % 2), float(i)], 1, 1) for i in range(4)], VECTORS)).collect()
    assert all(r.deviation == (1 << 63) - 1 for r in large)


# --- token files ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return token_files.read_file(public_tokenizers.path("word_bpe_49k.json"))


def test_code_round_trip():
    rng = np.random.default_rng(0)
    documents = [rng.integers(0, 1 << b, n).astype(np.uint32) for b in (1, 8, 9, 16, 17, 24, 25, 32) for n in (0, 1, 3, 4, 5, 100)]
    packed = [token_files.pack(d) for d in documents]
    assert [len(c) for c, _ in packed] == [-(-len(d) // 4) for d in documents]
    content = token_files.block(5, [(i or None, len(d), *p) for i, (d, p) in enumerate(zip(documents, packed, strict=True))]) + b"\n"
    ((start, ids, sizes, ranks), again) = token_files.blocks(content + content)
    assert start == 5 and ids[:2] == [None, 1] and sizes.tolist() == [len(d) for d in documents]
    assert (ranks == np.concatenate(documents)).all() and (again[3] == ranks).all()
    with pytest.raises(ValueError):
        list(token_files.blocks(content.replace(b"LTF1", b"LTF2")))


def test_pieces_have_the_ids_of_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(1)
    signs = [*"aAbzZ0129 '\".,;:!?()<>|-_\t\n\x0b\x1c\x1f\x85\xa0éÉçñß̱́ 　—…’", "'s", "'ll", "'RE", "<|endoftext|>", "H̱", "ẖ", "K", "İ", "Σ", "ς", "😀", "中文", "ﬁ", "가"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)]
    codec = token_files.WordCodec(tokenizer)
    expected = [e.ids for e in codec.core.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert [x.tolist() for x in codec.encode(raw)] == expected
    monkeypatch.setattr(token_files, "CACHE", 50)
    monkeypatch.setattr(token_files, "PART_BYTES", 16)
    assert [x.tolist() for x in codec.encode(raw)] == expected
    assert codec.encode([]) == []
    assert [len(x) for x in codec.encode([b"", b"a b c d e f g h i j k l"])] == [0, 12]  # the last part fills a buffer


def test_token_files(spark, tokenizer, tmp_path):
    texts = [(None, "no id"), (7, None), (3, ""), (11, "Hello, World! it's 2024 " * 3), (5, "one two"), (5, "one two"), (5, "another"), (-4, "x" * 5000 + " " + "word " * 60_000), (2, " \n ")]
    texts += [(100 + i, " ".join(random.Random(i).choices(["alpha", "Beta,", "gamma.", "delta42", "é"], k=i))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, 2, "t", 3) for i, t in texts], SCHEMA).repartition(5)
    path = f"file://{tmp_path}/ids"
    token_files.write(docs, tokenizer, 1, path, file_ids=5000)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    core = token_files.WordCodec(tokenizer).core
    ids = {t: core.encode(t or "", add_special_tokens=False).ids + [1] for _, t in texts}
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(ids[t])) for i, t in texts)
    by_id = {i: [ids[t] for k, t in texts if k == i] for i, _ in texts}
    start = 0
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        by_id[r.doc_id].remove(own)
        assert r.start == start
        start += len(own)
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in texts if i is not None)]
    names = [r.path for r in spark.read.format("binaryFile").load(f"{path}/ids/part-*").where("length > 0").select("path").orderBy("path").collect()]
    assert len(names) > 5
    first = [next(token_files.blocks(bytes(r.content)))[0] for r in spark.read.format("binaryFile").load(f"{path}/ids/part-*").where("length > 0").orderBy("path").collect()]
    assert first == sorted(first)  # files follow each other by name
    crcs = {(r.start, r.ids_crc32) for r in token_files.digests(spark, path).collect()}
    assert crcs == {(r.start, zlib.crc32(r.ids)) for r in got}


def test_token_files_of_nothing_and_frequency(spark, tokenizer):
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), tokenizer, 1).count() == 0
    docs = spark.createDataFrame([(i, "the cat", 0, 0, "", 0) for i in range(3)] + [(9, "the the the dog", 0, 0, "", 0)], SCHEMA)
    table = token_files.tokens(docs, tokenizer, 1)
    ids = [i for r in table.select("ids").collect() for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert token_files.ranked(table).tolist() == sorted(set(ids), key=lambda i: (-ids.count(i), i))
    assert token_files.round_trip(docs, tokenizer, 1).agg(F.max(F.expr("start + n_tokens"))).first()[0] == len(ids)
