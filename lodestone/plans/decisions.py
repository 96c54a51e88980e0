"""Decisions of standing jobs, queues, adaptive weights and facets' rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import digests as dg
from lodestone.functions import scalars as sc
from lodestone.functions import textrules as tr
from lodestone.operators import decisions, mining
from lodestone.plans import lanes, signals  # their queries are reused below
from lodestone.plans.registry import ORACLES, Tables, query, r6

R = "WITH " + schema.RECORDS_SQL
BASELINE, MIN_CONFIDENCE, MIN_ATTEMPTS = 0.5, 0.6, 2
STEERING = {"size": 1.0, "price": -0.5, "key": 0.0}
#: Words that a distilled text keeps.
KEPT_WORDS = 40


@query(f"""WITH p AS ({ORACLES['z14_recalled_together']}), u AS (SELECT s_suppkey AS s, CASE WHEN s_acctbal > 4000 THEN 1.0 ELSE 0.0 END AS reward FROM supplier),
x AS (SELECT p.a, p.b, p.n AS attempts, greatest(1 / (1 + exp(({BASELINE} - (x.reward + y.reward) / 2) / {decisions.TEMPERATURE})), CASE WHEN p.a % 5 = 0 THEN 0.8 * {decisions.RETENTION} ELSE 0 END) AS c FROM p JOIN u x ON x.s = p.a JOIN u y ON y.s = p.b)
SELECT a, b, attempts, round(c, 6) AS confidence, CASE WHEN (a + b) % 7 = 0 OR (a + b) % 11 = 0 THEN 'suppressed' WHEN c >= {MIN_CONFIDENCE} AND attempts >= {MIN_ATTEMPTS} THEN 'emitted' ELSE 'below' END AS decision FROM x""")
def r14_dreaming(t: Tables) -> DataFrame:
    """Pairs recalled together; the evidence is what both ends earned, some pairs have a confidence or a link already."""
    pairs = signals.z14_recalled_together(t)
    earned = t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 4000, 1.0).otherwise(0.0).alias("r"))
    seen = pairs.join(earned.toDF("a", "ra"), "a").join(earned.toDF("b", "rb"), "b").select("a", "b", F.col("n").alias("attempts"), ((F.col("ra") + F.col("rb")) / 2).alias("reward"))
    before = pairs.where("a % 5 = 0").select("a", "b", F.lit(0.8).alias("confidence"))
    known = pairs.where("(a + b) % 7 = 0 OR (a + b) % 11 = 0")
    out = decisions.dreamed(seen, ["a", "b"], before, known, BASELINE, MIN_CONFIDENCE, MIN_ATTEMPTS)
    return out.select("a", "b", "attempts", r6("confidence").alias("confidence"), "decision")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id % 3 <> 0")
def r03_scoped_drain(t: Tables) -> DataFrame:
    e = t("events")
    return decisions.open_jobs(e, e.where("event_id % 3 = 0"), "event_id", F.col("event_type") == "click").select("event_id", "user_id")


@query("WITH a AS (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS status FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderkey, coalesce(a.status, 'pending') AS status FROM orders LEFT JOIN a ON l_orderkey = o_orderkey")
def r04_settled_jobs(t: Tables) -> DataFrame:
    """Orders as jobs, their finished lines as acknowledgements in the order of their numbers."""
    acks = t("lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_returnflag").alias("status"))
    return decisions.settled(t("orders").select("o_orderkey"), acks, "o_orderkey", "l_linenumber", "status")


@query("WITH c AS (SELECT event_type, max(event_id) AS cursor FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type <> 'error' GROUP BY 1) SELECT event_type, min(event_id) AS next, count(*) AS n FROM events LEFT JOIN c USING (event_type) WHERE cursor IS NULL OR event_id > cursor GROUP BY 1")
def r05_cursor(t: Tables) -> DataFrame:
    """What is left behind each stream's cursor; errors have none yet."""
    e = t("events")
    cursors = e.where("ts < TIMESTAMP_NTZ '2024-01-10' AND event_type <> 'error'").groupBy("event_type").agg(F.max("event_id").alias("cursor"))
    return decisions.resumed(e, cursors, "event_type", "event_id").groupBy("event_type").agg(F.min("event_id").alias("next"), F.count(F.lit(1)).alias("n"))


def _weights_sql() -> str:
    bonus = {"locus": "doc_id % 2 = 0", "field_fit": "doc_id % 2 = 0", "bm25": "length(text) > 0", "vector": "length(text) > 0", "diversity": "doc_id % 10 > 5", "graph": "doc_id % 7 > 4.2"}
    raw = {k: f"{w} + CASE WHEN {bonus[k]} THEN {0.15 if k == 'diversity' else 0.1} ELSE 0 END" if k in bonus else str(w) for k, w in decisions.BASE_WEIGHTS.items()}
    return "SELECT doc_id, " + ", ".join(f"round(CAST({v} AS DOUBLE) / CAST({' + '.join(f'({x})' for x in raw.values())} AS DOUBLE), 6) AS {k}" for k, v in raw.items()) + " FROM documents"


@query(_weights_sql())
def d33_adaptive_weights(t: Tables) -> DataFrame:
    """Documents as questions; their predicates, redundancy and agreement stand for what a request has measured."""
    i = F.col("doc_id")
    weights = decisions.adaptive_weights(i % 2 == 0, F.length("text") > 0, (i % 10) / 10, (i % 7) / 7)
    return t("documents").select("doc_id", *(r6(w).alias(lane) for lane, w in weights.items()))


_TRAILED = "text || CASE WHEN doc_id % 2 = 0 THEN '  (*[ source=' || source || ' ]*)' || chr(10) ELSE '' END"


@query(rf"WITH x AS (SELECT doc_id, {_TRAILED} AS t FROM documents), y AS (SELECT doc_id, t, regexp_matches(t, '{tr.TRAILER}') AS has FROM x) SELECT doc_id, sha256(regexp_replace(CASE WHEN has THEN regexp_extract(t, '{tr.TRAILER}', 1) ELSE t END, '[ \t\n\x0B\f\r]+\z', '')) AS body, CASE WHEN has THEN regexp_replace(regexp_extract(t, '{tr.TRAILER}', 2), '\A[ \t\n\x0B\f\r]+', '') ELSE '' END AS trailer FROM y")
def x13_trailer(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  (*[ source="), "source", F.lit(" ]*)\n"))).otherwise("")).alias("t"))
    body, trailer = tr.split_trailer(F.col("t"))
    return d.select("doc_id", F.sha2(body, 256).alias("body"), trailer.alias("trailer"))


def _estimate(words: str, text: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN 0 ELSE (3 * strlen({text}) + 16 * len({words}) + 12) // 24 END"


@query(rf"WITH w AS (SELECT lang, text, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT lang, CAST(sum({_estimate('w', 'text')}) AS BIGINT) AS original, CAST(sum({_estimate(f'w[:{KEPT_WORDS}]', f'''array_to_string(w[:{KEPT_WORDS}], ' ')''')}) AS BIGINT) AS distilled FROM w GROUP BY 1) SELECT lang, original, distilled, original - distilled AS saved, CASE WHEN original = 0 THEN 0 WHEN original >= distilled THEN ((original - distilled) * 100 + original // 2) // original ELSE -(((distilled - original) * 100 + original // 2) // original) END AS percent FROM s")
def q33_distilled_savings(t: Tables) -> DataFrame:
    """Tokens before and after by language; the percentage is rounded half away from zero in whole numbers."""
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, KEPT_WORDS), " ")
    d = t("documents").where("text is not null").select("lang", sc.token_estimate(F.col("text")).cast("long").alias("o"), sc.token_estimate(short).cast("long").alias("d"))
    s = d.groupBy("lang").agg(F.sum("o").alias("original"), F.sum("d").alias("distilled"))
    saved = F.col("original") - F.col("distilled")
    size: Column = F.floor((F.abs(saved) * 100 + F.floor(F.col("original") / 2)) / F.col("original"))
    percent = F.when(F.col("original") == 0, F.lit(0)).otherwise(F.signum(saved).cast("long") * size).cast("long")
    return s.select("lang", "original", "distilled", saved.alias("saved"), percent.alias("percent"))


_FACETS = "unnest(['wing:' || wing, 'room:' || room, 'source_type:' || (provenance & 63)])"


@query(f"""{R}, i AS (SELECT doc_id, {_FACETS} AS item FROM r), l AS (SELECT DISTINCT item FROM i WHERE item IS NOT NULL ORDER BY 1 LIMIT 64), k AS (SELECT * FROM i WHERE item IN (SELECT item FROM l)), t AS (SELECT count(*) AS t FROM r),
o AS (SELECT a.item AS a, b.item AS b, count(*) AS n, array_to_string(list_sort(list(doc_id))[:5], ',') AS exemplars FROM k a JOIN k b USING (doc_id) GROUP BY 1, 2), m AS (SELECT a AS i, n AS ni FROM o WHERE a = b)
SELECT a AS antecedent, b AS consequent, round(n / t, 6) AS support, round(n / x.ni, 6) AS confidence, round((n / x.ni) / (y.ni / t), 6) AS lift, exemplars FROM o JOIN m x ON x.i = a JOIN m y ON y.i = b, t WHERE a <> b""")
def g11_estate_rules(t: Tables) -> DataFrame:
    r = schema.records(t("documents")).select("doc_id", "wing", "room", F.col("provenance").bitwiseAND(F.lit(63)).alias("source_type"))
    out = mining.facet_rules(r, "doc_id", ["wing", "room", "source_type"])
    return out.select("antecedent", "consequent", *(r6(c).alias(c) for c in ("support", "confidence", "lift")), "exemplars")


@query(f"WITH z AS ({ORACLES['z11_multi_seed_concepts']}), {lanes._ROWS.replace(' x AS', ' w AS')}, o AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM w a JOIN w b USING (row) GROUP BY 1, 2), d AS (SELECT o.a, list_sort(list(o.b)) AS xs FROM o JOIN o m ON m.a = o.a AND m.b = o.a AND m.n = o.n GROUP BY 1), c AS (SELECT string_split(intent, ';') AS xs FROM z UNION SELECT xs FROM d), s AS (SELECT a.xs AS below, b.xs AS above FROM c a JOIN c b ON list_has_all(b.xs, a.xs) AND len(a.xs) < len(b.xs)) SELECT array_to_string(below, ';') AS below, array_to_string(above, ';') AS above, array_to_string(list_sort(list_filter(above, lambda x: NOT list_contains(below, x))), ';') AS added FROM s WHERE NOT EXISTS (SELECT 1 FROM s m JOIN s n ON m.above = n.below WHERE m.below = s.below AND n.above = s.above)")
def g15_cover_deltas(t: Tables) -> DataFrame:
    """Concepts that lie directly below others, and the attributes that make the step."""
    li = t("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"))
    single = mining.attribute_concepts(mining.cooccurrence(li, li.columns)).select(F.transform("intent", lambda x: F.replace(x, F.lit(":"), F.lit("="))).alias("items"))
    concepts = lanes.z11_multi_seed_concepts(t).select(F.split("intent", ";").alias("items")).union(single)
    joined = lambda c: F.array_join(c, ";").alias(c)
    return mining.covers(concepts).select(joined("below"), joined("above"), joined("added"))


_G, _1, _2, _64 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 1 << 64


@query(f"WITH s AS (SELECT p_partkey, p_size, (p_partkey::UHUGEINT + (p_size + 1)::UHUGEINT * {_G}::UHUGEINT) % {_64}::UHUGEINT AS z FROM part), a AS (SELECT p_partkey, (xor(z, z // {1 << 30}::UHUGEINT) * {_1}::UHUGEINT) % {_64}::UHUGEINT AS z FROM s), b AS (SELECT p_partkey, (xor(z, z // {1 << 27}::UHUGEINT) * {_2}::UHUGEINT) % {_64}::UHUGEINT AS z FROM a) SELECT p_partkey, CAST(xor(z, z // {1 << 31}::UHUGEINT) AS VARCHAR) AS draw FROM b")
def d31_split_mix(t: Tables) -> DataFrame:
    """Of each part's own stream the output that its size names."""
    return t("part").select("p_partkey", dg.split_mix(F.col("p_partkey"), F.col("p_size")).alias("draw"))


@query("WITH c AS (SELECT p_partkey, p_size AS size, p_retailprice AS price FROM part), g AS (SELECT min(size) AS a, max(size) AS b, min(price) AS c, max(price) AS d FROM c) SELECT p_partkey, round(1.0 * (size - a) / (b - a) - 0.5 * (price - c) / (d - c), 6) AS score FROM c, g")
def z18_steered(t: Tables) -> DataFrame:
    """Parts by size against price; the key's column is switched off."""
    p = t("part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("key"))
    ranged = decisions.with_ranges(p, list(STEERING))
    return ranged.select("p_partkey", r6(decisions.steered(ranged, STEERING)).alias("score"))
