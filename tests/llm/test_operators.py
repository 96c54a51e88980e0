"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from lodestone.llm import bpe, brown_lm, jaccard_join, kd_shards, line_rules, mixing, paragraphs, pii, topk_search, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, uid string, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    return " ".join(hashlib.md5(f"{seed}{i}".encode()).hexdigest()[:5].translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(n))


def texts():
    base = words(120, "b")
    near = base.split()
    near[60] = "changed"
    passage = words(60, "p")
    return [
        (0, base, "en", "s0"), (1, base, "en", "s0"), (2, " ".join(near), "fr", "s1"), (3, None, None, None), (4, "", "en", "s0"),
        (5, "one two", "de", "s2"), (6, "one two", "de", "s2"), (7, f"{words(40, 'x')} {passage} {words(30, 'y')}", "en", "s1"), (8, f"{words(55, 'z')}\n{passage}\n{words(20, 'w')}", "es", "s3"),
        (9, "mail a.b@c.de_f@g.hi ip 1.2.3.4.5.6.7.8 300.1.1.1 card 4111 1111-1111 1111 call +1 (988) 555-2485 now", "en", "s0"),
        (10, "x" * 70_000 + " " + words(20_000, "long"), "en", "s4"), (11, "   \n\t ", "en", "s0"), (5, "one two", "de", "s2"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "n", "u", 1) for r in texts()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = {r.doc_id: r for r in bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()}
    codec = bpe.Codec.of(ranks, public_tokenizers.PATTERN)
    for i, t, *_ in texts():
        ids = codec.core.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(none, ranks, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(docs.where("doc_id = 7"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).first()["bytes"].decode() == texts()[7][1]


def test_line_rules(docs, none):
    got = {r.doc_id: r for r in line_rules.rules(docs).collect()}
    for i, t, *_ in texts():
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(again))
    assert got[0].kept and not got[4].kept and not got[3].kept
    assert line_rules.rules(none).count() == 0


def test_boilerplate_lines(spark):
    line = "the same line of ten words stands in all documents"
    rows = [(i, f"{line}\n{words(60, i)}" if i % 2 else f"{line}\n{line} {line} {words(3, i)}", "h") for i in range(60)]
    got = {r.doc_id: r for r in line_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 10 for i in got)
    assert all(got[i].kept == bool(i % 2) for i in got)


def test_several_boilerplate_lines(spark):
    template = [f"{words(6, f'line {k}')}" for k in range(10)]
    rows = [(i, "\n".join([*template, words(60, f"body {i}")]), "h") for i in range(60)] + [(100 + i, f"{words(60, 'copy')}\n{words(9, 'copied')}", "g") for i in range(60)]
    got = {r.doc_id: r for r in line_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 60 for i in range(60))
    assert all(got[100 + i].removed_words == 0 for i in range(60))


def test_boilerplate_lines_leave_the_texts(spark, docs):
    body = [f"Größe {words(60, f'body {i}')}\n\nmore {words(9, f'more {i}')}" for i in range(60)]
    cast = lambda i: ["The  Header of all pages", body[i].split("\n")[0], "", body[i].split("\n")[2], "the header\tOF all pages", "a footer of all pages"]
    rows = [(None if i == 7 else i, "\n".join(cast(i)), None if i < 30 else "h", len("\n".join(cast(i)))) for i in range(60)] + [(100 + i, f"{words(60, f'other {i}')}\na footer of all pages", "g", None) for i in range(5)]
    got = line_rules.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_chars) for r in got.collect() if (r.doc_id or 0) < 100) == sorted((-1 if i == 7 else i, body[i], len(body[i])) for i in range(60))
    assert {(r.doc_id, r.text, r.n_chars) for r in got.where("doc_id >= 100").collect()} == {(i, t, n) for i, t, _, n in rows[60:]}
    assert line_rules.kept_documents(docs).columns == docs.columns


def test_jaccard_join(docs, none):
    got = {r.doc_id: r for r in jaccard_join.join(docs).collect()}

    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t, *_ in texts()}
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {i: r.component_id for i, r in got.items()} == parent
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert jaccard_join.join(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parent.values()))


def test_jaccard_join_row_without_id_first(spark):
    near = words(120, "n").split()
    near[60] = "changed"
    rows = [(None, words(120, "n")), (1, words(120, "n")), (2, " ".join(near)), (3, words(120, "other"))]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {None: None, 1: 1, 2: 1, 3: 3}


def test_pipeline_near_copies(spark):
    rows = []
    for i, n in enumerate((49, 50, 48)):  # one changed word: 40 of 50, 41 of 51 and 39 of 49 shingles of five words
        text = words(n, f"near {i}").split()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:24], "changed", *text[25:]]))]
    kept = corpus_pipeline.jaccard_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]


def test_paragraphs(docs, none):
    got = paragraphs.repeated(docs).collect()
    assert {7, 8} <= {r.doc_id for r in got} and {0, 1, 2} <= {r.doc_id for r in got}
    assert not {9, 3, 4, 11} & {r.doc_id for r in got}
    assert paragraphs.repeated(none).count() == 0


def test_near_copies_of_short_documents(spark):
    rows = []
    for i in range(20):
        text = words(60, f"short {i}").split()
        rows += [(4 * i, " ".join(text)), (4 * i + 1, " ".join([*text[:30], "changed", *text[31:]]))]
        rows += [(4 * i + 2, words(54, f"edge {i}")), (4 * i + 3, " ".join(words(54, f"edge {i}").split()[:50]))]
    got = {r.doc_id for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).where("removed and word_start = 0 and word_end >= 50").collect()}
    assert got == {i for i in range(80) if i % 4 in (1, 3)}


def test_paragraphs_hold_all_words(spark):
    rows = [(i, words(51 + i, f"whole {i}")) for i in range(150)]
    held = {i: set() for i, _ in rows}
    for r in paragraphs.paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        held[r.doc_id] |= set(range(r.word_start, r.word_end))
    assert all(held[i] == set(range(51 + i)) for i in held)
    assert paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    t = texts()[9][1]
    kinds = [s.split(":") for s in got[9].spans.split(",")]
    assert [(k, t[int(a) : int(b)]) for k, a, b in kinds] == [("email", "a.b@c.de"), ("email", "_f@g.hi"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (988) 555-2485")]
    assert got[3].spans == "" and len(got) == 12
    assert pii.spans(none).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[9] == "mail <EMAIL><EMAIL> ip <IP>.<IP> 300.1.1.1 card <CARD> call <PHONE> now"
    assert clean[3] is None and clean[0] == texts()[0][1]


def test_pii_numbers_and_handles(spark):
    rows = [(i, f"{words(4, i)} phone: +1-988-555-{1000 + i} {words(4, -i)} contact: someone{i}@mail{i}.example") for i in range(40)]
    rows += [(100, "my phone: 988-555-2485 now"), (101, "please contact: @some_handle today"), (102, "in the year 1999-2000 or at 12345678 there")]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:10:22" and got[101] == "id:16:28" and got[102] == ""


def test_shards(docs, none):
    got = kd_shards.shards(docs, n_shards=3).collect()
    assert len(got) == len(texts())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.size == len((dict((i, t) for i, t, *_ in texts())[r.doc_id] or "").encode()) + 8 for r in got)
    assert all(r.text_crc32 == zlib.crc32((dict((i, t) for i, t, *_ in texts())[r.doc_id] or "").encode()) for r in got)
    assert kd_shards.shards(none, n_shards=3).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs, epochs=2, share=(1, 2)).collect()
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in texts())
    assert sum(r.n_tokens for r in got) <= total // 2
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-1.0, 3.0]), (100, [2.0, -0.3]), (6, [1.0, 0.5])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    import math

    ok = {i: [math.floor(1024 * x) for x in v] for i, v in [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (5, [-1.0, 3.0]), (100, [2.0, -0.30000001192092896]), (6, [1.0, 0.5])]}
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[i], strict=True)), i) for i in ok if i != q)[:3]
        assert [(r.vec_id, -r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, s) for s, i in best]
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_model(docs, none):
    got = {r.doc_id: r for r in brown_lm.scores(docs, classes=4, core=32, head=64).collect()}
    assert got[3].n_tokens == 1 and got[5].n_tokens == 3
    assert all(r.score < 0 for r in got.values())
    assert brown_lm.scores(none).count() == 0


def test_toxicity(spark, none):
    rows = [(i, f"{words(20, i)} {'you stupid idiot' if i % 3 == 0 else 'fine'} {words(5, -i)}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    found = toxicity.scores(spark.createDataFrame([*rows, (900, "such an idoit idiott, you stuppid"), (901, None)], "doc_id long, text string"), labels)
    got = {r.doc_id: r.predicted for r in found.collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(300)) and got[900] == 1 and got[901] == 0
    assert toxicity.scores(none, labels).count() == 0


def test_pii_names_that_clash(spark):
    taken = ["uid", "email", "ip", "card", "phone", "id", "instances", "row", "_t", "_e", "start", "spans", "base"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in taken)
    text = "mail a.b@c.de and 1.2.3.4 end"
    rows = [(1, text, len(text), *(f"mine {c}" for c in taken)), (None, None, None, *(None for _ in taken)), (3, "", 0, *("x" for _ in taken))]
    got = pii.redacted(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "n_chars", *taken]
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].text == "mail <EMAIL> and <IP> end" and by_id[1].n_chars == len(by_id[1].text)
    assert all(by_id[1][c] == f"mine {c}" for c in taken)
    assert by_id[None].text is None and by_id[3].text == ""
    back = paragraphs.without_repeats(spark.createDataFrame(rows, schema))
    assert back.columns == got.columns and {r.doc_id: r.text for r in back.collect()} == {1: text, None: None, 3: ""}


def test_pii_many_matches_in_one_text(spark):
    n = 5_000
    text = " ".join(f"é{i} x{i}@y{i}.zz 1.2.3.{i % 300}" for i in range(n))
    got = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_email == n and got.n_ip == sum(i % 300 <= 255 for i in range(n))
    at = [m.span() for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.zz", text)]
    assert got.spans.startswith(",".join(f"email:{a}:{b}" for a, b in at[:2000]))
    clean = pii.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean.startswith("é0 <EMAIL> <IP> é1 <EMAIL> <IP>") and clean.count("<EMAIL>") == n


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "stupid", "moronically", "bad"]
    matcher = toxicity.Matcher(terms, ["vile"])
    letters = "idotsupmrncalybe"
    import random

    random.seed(1)
    tried = set(terms) | {"vilest", "vile", "vil"}
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(random.randint(0, 3)):
                i = random.randrange(len(w) + 1)
                random.choice([lambda: w.insert(i, random.choice(letters)), lambda: w.pop(i % len(w)) if len(w) > 1 else None, lambda: w.__setitem__(i % len(w), random.choice(letters))])()
            tried.add("".join(w))
    for w in tried:
        near = any(distance(w, t) <= toxicity.edits_allowed(t) for t in terms)
        assert (matcher.kind(w) > 0) == (near or w.startswith("vile")), w


def test_language_model_base(docs):
    import math

    rows = texts()
    words = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, *_ in rows if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    for r in brown_lm.scores(docs, classes=4, core=32, head=64).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words[r.doc_id]), sum(counts[w] > 0 for w in words[r.doc_id]), n, held[r.doc_id])
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[r.doc_id])) < 1e-6 * len(words[r.doc_id])


def test_pipeline_stages(spark, docs, none):
    bad = [(None, None, None, None), (None, "", "en", "s0"), (None, words(80, "unnamed"), "en", "s0"), (None, words(80, "unnamed"), "en", "s0"), (None, "too short", "en", None), (77, words(80, "named"), "en", None), (77, words(80, "named"), "en", None)]
    odd = spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "n", "u", 1) for r in bad], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0, name
        for table in (docs, odd):
            got = stage(spark, table, "")
            assert got.columns == table.columns, name
            rows = {tuple(r)[:1] for r in table.collect()}
            assert {tuple(r)[:1] for r in got.collect()} <= rows, name
    assert sorted((r.doc_id or 0, r.text[:5]) for r in corpus_pipeline.quality_rules(spark, odd, "").collect()) == sorted((i or 0, t[:5]) for i, t, *_ in bad if t and len(t) > 80)
    kept = corpus_pipeline.jaccard_dedup(spark, odd, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if len(r.text or "") > 80) == sorted([(0, words(80, "unnamed")), (77, words(80, "named"))])
    tokens = corpus_pipeline.encode_bpe(spark, odd, "")
    assert tokens.count() == len(bad) and corpus_pipeline.encode_bpe(spark, none, "").count() == 0


def test_shards_balance(spark):
    rows = [(i, words(20 + i % 60, f"shard {i}"), "en" if i % 3 else "de", f"s{i % 5}" if i % 2 else "hot", 100 + i) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weight = lambda got: [sum(r.size for r in got if r.shard == s) for s in sorted({r.shard for r in got})]
    total = sum(len(r[1].encode()) + 8 for r in rows)
    sizes = weight(kd_shards.shards(docs, n_shards=6).collect())
    assert len(sizes) == 6 and sum(sizes) == total and max(sizes) - min(sizes) <= 0.05 * total / 6
    by_target = weight(kd_shards.shards(docs, target_bytes=total // 4 + 1000).collect())
    assert len(by_target) == 4 and max(by_target) <= total // 4 + 1000


def test_paragraph_recall_against_all_pairs(spark):
    import random

    random.seed(4)
    rows = []
    for g in range(12):
        base = words(70, f"recall {g}").split()
        for _ in range(6):
            text = list(base)
            for _ in range(random.randint(0, 2)):
                text[random.randrange(len(text))] = words(1, random.random())
            rows.append((len(rows), " ".join(text)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).where("word_start = 0 and word_end = 70").collect()
    of = {r.doc_id: r.component_id for r in got}
    found = sum(a in of and of[a] == of.get(b) for a, b in pairs)
    assert len(pairs) > 60 and found >= 0.9 * len(pairs)
    for a in of:  # nothing is linked across groups
        assert all(of[a] != of[b] for b in of if a // 6 != b // 6)


def test_mixing_by_source_weights(spark):
    rows = [(i, "w " * 10, "en", f"s{4 * (i % 2)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, epochs=1, share=(1, 2), domains={}, langs={}, sources={"s0": 3, "s4": 1}).groupBy("source").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == {"s0": 1500, "s4": 500}


def test_paragraphs_of_repeated_rows_and_rows_without_id(spark):
    text = words(60, "row").split()
    near = [*text[:30], "changed", *text[31:]]
    schema = "doc_id long, text string"
    null = paragraphs.repeated(spark.createDataFrame([(None, " ".join(text)), (None, " ".join(near))], schema)).collect()
    one = paragraphs.repeated(spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near))], schema)).collect()
    key = lambda rows: sorted((r.word_start, r.word_end, r.occurrences, r.removed) for r in rows)
    assert null and key(null) == key(one) and any(r.removed for r in null)
    same = paragraphs.repeated(spark.createDataFrame([(5, " ".join(text)), (5, " ".join(text))], schema)).collect()
    assert sum(r.removed for r in same) * 2 == len(same) > 0


def test_shards_part_repeated_rows(spark):
    got = kd_shards.shards(spark.createDataFrame([(1, "same text", "en", "s", 9)] * 40, "doc_id long, text string, lang string, source string, n_chars long"), n_shards=4).collect()
    assert sorted(Counter(r.shard for r in got).values()) in ([10] * 4, [9, 10, 10, 11], [9, 9, 11, 11])


def test_top_k_of_repeated_queries(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5])] + [(i, [1.0 / i, 0.1]) for i in range(1, 8)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    once = topk_search.top_k(spark.createDataFrame(rows[1:], "vec_id long, embedding array<double>"), k=3).collect()
    key = lambda found: Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    assert len(once) == 3 and key(got) == Counter({k: 2 for k in key(once)})
