"""Content fingerprints against fixed vectors, a plain count, and the Hamming join against all pairs."""

import random

import pytest

from lodestone.operators import fingerprints as fp

FOX = "The quick brown fox jumps over the lazy dog"
MASK = (1 << 64) - 1


def plain(text):
    low = text.lower()
    shingles = {low[i : i + 3] for i in range(len(low) - 2)} or ({low} if low else set())
    out = []
    for salt in fp.SALTS:
        votes = [0] * 64
        for s in shingles:
            h = fp.START
            for byte in (salt + s).encode():
                h = (h ^ byte) * fp.PRIME & MASK
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
        out.append(sum(1 << i for i, v in enumerate(votes) if v > 0))
    return out


def unsigned(blocks):
    return [x & MASK for x in blocks]


def distance(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(unsigned(a), unsigned(b)))


def test_fixed_vectors():
    assert unsigned(fp.blocks_of(FOX)) == [0x2B60F941D15CAEE5, 0x1C47031194216C3A, 0x0DD73D2100654F5F, 0xB3CACB0CD2AEEA7C]
    assert unsigned(fp.blocks_of("ab")) == [0x32F20CC2F25D2AF7, 0x7F4A8CCBA9F51C9E, 0x3E4E64B3921FC98D, 0x7DC1B4B9FF22AC34]
    assert fp.blocks_of("") == fp.blocks_of(None) == [0] * 4
    assert fp.blocks_of(FOX.upper()) == fp.blocks_of(FOX)
    assert distance(fp.blocks_of(FOX), fp.blocks_of("The quick brown fox jumped over the lazy dogs")) == 30
    assert distance(fp.blocks_of(FOX), fp.blocks_of("Quarterly revenue rose nine percent on services")) == 92


def test_fingerprints_of_rows(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "a", "é", "ábc", "日本語のテキスト", "x" * 5000, *("".join(rng.choice("abcdeÄ \n😀") for _ in range(rng.randrange(200))) for _ in range(30))]
    rows = spark.createDataFrame([(i, x, "other") for i, x in enumerate(texts)], "id long, text string, b0 string")
    got = {r.id: [r.b0, r.b1, r.b2, r.b3] for r in fp.content_fingerprints(rows, "id", "text").collect()}
    assert {i: unsigned(x) for i, x in got.items()} == {i: plain(x or "") for i, x in enumerate(texts)}
    monkeypatch.setattr(fp, "_AT_ONCE", 7)
    assert fp.blocks_of(texts[-1]) == got[len(texts) - 1]
    assert fp.content_fingerprints(rows.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("most", [15, 31])
def test_hamming_join_is_exact(spark, most):
    rng = random.Random(most)
    centres = [rng.getrandbits(256) for _ in range(12)]
    values = [0, 0]
    for c in centres:
        values.append(c)
        for _ in range(12):
            v = c
            for bit in rng.sample(range(256), rng.choice([1, 15, 16, 30, 31, 32, 40])):
                v ^= 1 << bit
            values.append(v)
    # two bits in each part but one: one bit in that part, 31 in all
    spread = centres[0] ^ sum(3 << 16 * i for i in range(15)) ^ 1 << 240
    values += [spread, spread, centres[0]]
    signed = lambda v, i: ((v >> 64 * i & MASK) ^ 1 << 63) - (1 << 63)
    f = spark.createDataFrame([(i, *(signed(v, j) for j in range(4))) for i, v in enumerate(values)], "id long, b0 long, b1 long, b2 long, b3 long")
    got = fp.near(f, f.where("id % 3 = 0").withColumnRenamed("id", "probe"), "id", most).collect()
    want = {(p, i, (values[p] ^ v).bit_count()) for p in range(0, len(values), 3) if values[p] for i, v in enumerate(values) if v and (values[p] ^ v).bit_count() <= most}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    with pytest.raises(ValueError, match="31"):
        fp.near(f, f, "id", 32)


def test_hamming_join_shuffles_no_pairs(spark):
    f = spark.range(200).selectExpr("id", "id + 1 AS b0", "0L AS b1", "0L AS b2", "0L AS b3")
    found = fp.near(f, f.where("id % 10 = 0").withColumnRenamed("id", "probe"), "id")
    assert found.count() == 200 * 20
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()
