"""Queries on single rows: filters, dates, bits, text rules and distances, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import scalars as sc
from lodestone.functions import textrules as tr
from lodestone.operators import bits, dates
from lodestone.operators import predicates as pr
from lodestone.plans.catalog import _B, _FP_SQL, fingerprints
from lodestone.plans.registry import ORACLES, QUERIES, Tables, query, r6

R = "WITH " + schema.RECORDS_SQL

for _name, (_p, _sql) in {
    "f18_lineage_id": (lambda: pr.FILTERS["lineage_id"]("l4"), "lineage_id = 'l4'"),
    "f18_created_after": (lambda: pr.FILTERS["created_after"](F.lit("2024-01-10").cast("timestamp_ntz")), "filed_at > TIMESTAMP '2024-01-10'"),
    "f18_created_before": (lambda: pr.FILTERS["created_before"](F.lit("2024-01-10").cast("timestamp_ntz")), "filed_at < TIMESTAMP '2024-01-10'"),
    "f18_event_after": (lambda: pr.FILTERS["event_after"](F.lit("2024-01-09").cast("timestamp_ntz")), "event_time >= TIMESTAMP '2024-01-09'"),
    "f18_event_before": (lambda: pr.FILTERS["event_before"](F.lit("2024-01-09").cast("timestamp_ntz")), "event_time <= TIMESTAMP '2024-01-09'"),
    "f18_lattice_anchor": (lambda: pr.FILTERS["lattice_anchor"]({"udc_code": "3.2", "qid": "Q23"}), "udc_code = '3.2' AND qid = 'Q23'"),
    "f18_lattice_under": (lambda: pr.FILTERS["lattice_under"]("7."), "udc_code LIKE '7.%'"),
    "f18_wikidata_concept": (lambda: pr.FILTERS["wikidata_concept"]("Q2"), "qid = 'Q2' OR list_contains(qids_secondary, 'Q2')"),
    "f06_null_tests": (lambda: pr.is_null("text") | (pr.is_not_null("lineage_id") & pr.is_null("wing")), "text IS NULL OR (lineage_id IS NOT NULL AND wing IS NULL)"),
    "f02_all_of_nothing": (lambda: pr.all_of(), "true"),
    "f03_any_of_nothing": (lambda: pr.any_of(), "false"),
    "f16_typed_order": (lambda: (F.col("udc_code") >= "3.5") & (F.col("udc_code") < "6"), "udc_code >= '3.5' AND udc_code < '6'"),
    "f29_date_window": (lambda: dates.parse("what happened on 9 January 2024?").contains(F.col("event_time")), "CAST(event_time AS DATE) = DATE '2024-01-09'"),
    "f30_window_contains": (lambda: dates.parse("notes of Jan 2024").contains(F.col("event_time")), "CAST(event_time AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
    "f31_window_padded": (lambda: dates.parse("2024-01-20").padded(3).contains(F.col("event_time")), "CAST(event_time AS DATE) BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'"),
    "f33_month_over_years": (lambda: pr.any_of(*(w.contains(F.col("event_time")) for w in dates.over_years(dates.parse("in february"), 2023, 2025))), "month(event_time) = 2 AND year(event_time) BETWEEN 2023 AND 2025"),
    "f34_anomalous_gate": (lambda: pr.anomalous_gate(False), "operational & 67108864 = 0"),
    "d05_two_clocks": (lambda: (F.col("filed_at") > F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("event_time") >= F.lit("2024-01-07").cast("timestamp_ntz")), "filed_at > TIMESTAMP '2024-01-05' AND event_time >= TIMESTAMP '2024-01-07'"),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, p=_p: schema.records(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(p()).select("doc_id")
    ORACLES[_name] = f"{R} SELECT doc_id FROM r WHERE {_sql}"


@query(R + " SELECT doc_id, operational | (CAST(1 AS BIGINT) << 26) AS set_flag, operational & ~(CAST(1 AS BIGINT) << 20) AS cleared, (operational >> 20) & 1 AS was FROM r")
def f24_bit_flags(t: Tables) -> DataFrame:
    r = schema.records(t("documents"))
    c = F.col("operational")
    return r.select("doc_id", c.bitwiseOR(F.lit(1 << 26)).alias("set_flag"), c.bitwiseAND(F.lit(~(1 << 20))).alias("cleared"), F.getbit(c, F.lit(20)).cast("long").alias("was"))


_STATES = R + ", s AS (SELECT doc_id, adjective & 63 AS a, lead(adjective & 63) OVER (PARTITION BY lineage_id ORDER BY doc_id) AS b FROM r), legal(a, b) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in pr.TRANSITIONS) + ")"


@query(_STATES + " SELECT doc_id, a AS before, b AS after FROM s WHERE b IS NOT NULL AND (a, b) NOT IN (SELECT a, b FROM legal)")
def f26_illegal_transitions(t: Tables) -> DataFrame:
    return pr.illegal_transitions(schema.records(t("documents")).select("doc_id", "lineage_id", schema.STATE.value().alias("state")), "lineage_id", "doc_id", "state").select("doc_id", "before", "after")


@query(R + " SELECT doc_id, adjective, operational, provenance FROM r WHERE room = 'en'")
def f27_bitmap_only(t: Tables) -> DataFrame:
    return pr.hydrated(schema.records(t("documents")).where("room = 'en'"), "bitmap").select("doc_id", "adjective", "operational", "provenance")


@query(r"SELECT conv_id, turn, regexp_matches(regexp_replace(lower(text), ' +', ' ', 'g'), '(^| )[.,!?;:()''""]*(when[.,!?;:()''""]* [.,!?;:()''""]*(did|was|will|is)|(what|which)[.,!?;:()''""]* [.,!?;:()''""]*(date|day|year|month)|how[.,!?;:()''""]* [.,!?;:()''""]*long[.,!?;:()''""]* [.,!?;:()''""]*ago)[.,!?;:()''""]*( |$)') AS asks FROM conversations".replace('""', '"'))
def f32_date_seeking(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", dates.asks_for_date(F.col("text")).alias("asks"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), '[\"“”]') OR " + " OR ".join(f"contains(lower(text), '{c}')" for c in dates.CUES) + " AS routed FROM conversations")
def f35_conversation_route(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", dates.about_conversation(F.col("text")).alias("routed"))


# --- fingerprints

_PROBE = _FP_SQL + ", p AS (SELECT b0 AS q0, b1 AS q1, b2 AS q2, b3 AS q3 FROM f WHERE doc_id = 0)"
_Q = [f"q{i}" for i in range(4)]
_DIST = "(CAST(bit_count(xor(b0, q0)) AS BIGINT) + bit_count(xor(b1, q1)) + bit_count(xor(b2, q2)) + bit_count(xor(b3, q3)))"


def _probed(t: Tables, probe: int = 0) -> DataFrame:
    f = fingerprints(t("documents"))
    return f.join(F.broadcast(f.where(F.col("doc_id") == probe).limit(1).select(*(F.col(b).alias(q) for b, q in zip(_B, _Q, strict=True)))))


@query(_PROBE + " SELECT doc_id, round((CAST(bit_count(b0 & q0) AS BIGINT) + bit_count(b1 & q1) + bit_count(b2 & q2) + bit_count(b3 & q3)) / (CAST(bit_count(b0 | q0) AS BIGINT) + bit_count(b1 | q1) + bit_count(b2 | q2) + bit_count(b3 | q3)), 6) AS likeness FROM f, p")
def u02_bit_jaccard(t: Tables) -> DataFrame:
    return _probed(t).select("doc_id", r6(bits.jaccard(_B, _Q)).alias("likeness"))


@query(_PROBE + f" SELECT doc_id, round(1 - {_DIST} / 256.0, 6) AS likeness FROM f, p")
def d10_hamming_similarity(t: Tables) -> DataFrame:
    return _probed(t).select("doc_id", r6(1 - sc.hamming(_B, _Q) / 256.0).alias("likeness"))


@query(_PROBE + f" SELECT doc_id, {_DIST} AS distance FROM f, p ORDER BY distance DESC, doc_id LIMIT 20")
def t14_farthest(t: Tables) -> DataFrame:
    return _probed(t).select("doc_id", sc.hamming(_B, _Q).cast("long").alias("distance")).orderBy(F.desc("distance"), "doc_id").limit(20)


_PART = "(1 - (CAST(bit_count(xor(b0, q0)) AS BIGINT) + bit_count(xor(b1, q1))) / 128.0) * (bit_count(xor(b3, q3)) / 64.0)"


@query(_PROBE + f" SELECT doc_id, round({_PART}, 9) AS score FROM f, p WHERE doc_id <> 0 ORDER BY score DESC, doc_id LIMIT 20")
def t10_partial_blocks(t: Tables) -> DataFrame:
    score = bits.partial_match([0, 1], [3], _B, _Q)
    return _probed(t).where("doc_id <> 0").select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def _signs(columns: list[str], seed: int) -> str:
    return ", ".join(f"CAST(({' + '.join(f'CAST(bit_count(xor({c}, CAST({bits.signed(w)} AS BIGINT))) AS BIGINT)' for c, w in zip(columns, p, strict=True))}) * 2 < {64 * len(columns)} AS INT) AS s{k}" for k, p in enumerate(bits.planes(seed, 64, len(columns))))


_PACK = " + ".join(f"CAST(s{k} AS HUGEINT) * {1 << k}" for k in range(64))
_SIGNED = f"CAST(CASE WHEN ({_PACK}) >= 9223372036854775808 THEN ({_PACK}) - 18446744073709551616 ELSE ({_PACK}) END AS BIGINT)"


@query(f"{R}, s AS (SELECT doc_id, {_signs(['adjective', 'operational', 'provenance'], 7)} FROM r) SELECT doc_id, {_SIGNED} AS block FROM s")
def d12_simhash(t: Tables) -> DataFrame:
    return schema.records(t("documents")).select("doc_id", bits.simhash(["adjective", "operational", "provenance"], 7).alias("block"))


@query(f"{R}, s0 AS (SELECT doc_id, {_signs(['adjective', 'operational', 'provenance'], 7)} FROM r), a AS (SELECT doc_id, {_SIGNED} AS bitmaps FROM s0), s1 AS (SELECT doc_id, {_signs(['n_chars', 'doc_id'], 9)} FROM r), b AS (SELECT doc_id, {_SIGNED} AS place FROM s1) SELECT doc_id, bitmaps, place FROM a JOIN b USING (doc_id)")
def d13_row_fingerprint(t: Tables) -> DataFrame:
    r = schema.records(t("documents"))
    return r.select("doc_id", bits.simhash(["adjective", "operational", "provenance"], 7).alias("bitmaps"), bits.simhash(["n_chars", "doc_id"], 9).alias("place"))


_PLANES = bits.planes(11, 16, 1)


@query("SELECT vec_id, CAST(" + " + ".join("CASE WHEN list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (CASE WHEN (" + "[" + ",".join(str(p[0] >> j & 1) for j in range(64)) + "])[i] = 1 THEN 1 ELSE -1 END))) > 0 THEN " + str(1 << k) + " ELSE 0 END" for k, p in enumerate(_PLANES)) + " AS BIGINT) AS signs FROM embeddings")
def d15_float_simhash(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", bits.float_simhash(F.col("embedding"), 64, 11, 16).alias("signs"))


@query()
def d17_morton(t: Tables) -> DataFrame:
    return fingerprints(t("documents")).select("doc_id", bits.morton(_B).alias("key"))


@query(_FP_SQL + " SELECT lang, count(*) AS total, " + ", ".join("CAST(" + " + ".join(f"CAST(sum((b{j} >> {i}) & 1) * 2 > count(*) AS BIGINT) * {1 << i}" for i in range(60)) + f" AS BIGINT) AS b{j}" for j in range(4)) + " FROM f GROUP BY lang")
def a11_prototype(t: Tables) -> DataFrame:
    return bits.votes(fingerprints(t("documents")), ["lang"], _B)


@query("SELECT l_orderkey, l_linenumber, round(1 - exp(-l_linenumber / 3.0), 6) AS graph, round(0.5 * (l_quantity / 100) + 0.5 * (1 - exp(-l_linenumber / 3.0)), 6) AS combined, round(0.5 * (0.5 * (l_quantity / 100) + 0.5 * (1 - exp(-l_linenumber / 3.0))) + 0.5 * l_discount, 6) AS composite FROM lineitem")
def d26_composite_distance(t: Tables) -> DataFrame:
    graph = sc.graph_distance(F.col("l_linenumber"))
    combined = sc.halves(F.col("l_quantity") / 100, graph)
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(graph).alias("graph"), r6(combined).alias("combined"), r6(sc.halves(combined, F.col("l_discount"))).alias("composite"))


QUERIES["d24_graph_distance"] = lambda spark, sf_dir: QUERIES["d26_composite_distance"](spark, sf_dir).select("l_orderkey", "l_linenumber", "graph")
ORACLES["d24_graph_distance"] = f"SELECT l_orderkey, l_linenumber, graph FROM ({ORACLES['d26_composite_distance']})"
QUERIES["d25_combined_distance"] = lambda spark, sf_dir: QUERIES["d26_composite_distance"](spark, sf_dir).select("l_orderkey", "l_linenumber", "combined")
ORACLES["d25_combined_distance"] = f"SELECT l_orderkey, l_linenumber, combined FROM ({ORACLES['d26_composite_distance']})"

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(p.embedding[i] AS DOUBLE)))"


@query(f"SELECT e.vec_id, round({_DOT}, 5) AS dot, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE), 2)))), 5) AS l2 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p")
def d21_dense_metrics(t: Tables) -> DataFrame:
    e = t("embeddings")
    probe = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(probe)).select("vec_id", *(F.round(sc.METRICS[m](F.col("embedding"), F.col("q")), 5).alias(m) for m in ("dot", "l2")))


@query("SELECT event_id, CASE WHEN b = 0 THEN 0 ELSE row_number() OVER (PARTITION BY user_id, ms ORDER BY event_id) - 1 END AS logical, ms AS physical FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, 1 AS b FROM events)")
def d03_clock_send(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    e = t("events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("physical"))
    return e.select("event_id", (F.row_number().over(Window.partitionBy("user_id", "physical").orderBy("event_id")) - 1).cast("long").alias("logical"), "physical")


@query("SELECT event_type, round(sum(value * exp(-ln(2) * (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0 / 7)), 4) AS mass FROM events GROUP BY 1")
def d08_decay_and_add(t: Tables) -> DataFrame:
    e = t("events")
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000000
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).groupBy("event_type").agg(F.round(F.sum(F.col("value") * sc.decay(age, 7 * 86400.0)), 4).alias("mass"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, round(count(*) * exp(-ln(2) * 3 / 7.0), 4) AS cell FROM lineitem GROUP BY 1, 2")
def d07_matrix_decay(t: Tables) -> DataFrame:
    cells = t("lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return cells.select("a", "b", F.round(F.col("n") * sc.decay(F.lit(3.0), 7.0), 4).alias("cell"))


# --- text rules


@query(r"SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r]+', ' ', 'g')) AS name FROM documents")
def x21_name(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tr.name(F.coalesce("text", F.lit(""))).alias("name"))


@query("SELECT p_partkey, regexp_full_match(code, '[0-9]{3}(\\.[0-9]{1,8})?') AS ok FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '0.5' WHEN 1 THEN '0' || p_size || '1' WHEN 2 THEN '123.' ELSE '540.' || p_partkey END AS code FROM part)")
def x29_well_formed_code(t: Tables) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    code = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit("0.5"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("0"), size, F.lit("1"))).when(F.col("p_partkey") % 4 == 2, "123.").otherwise(F.concat(F.lit("540."), key))
    return t("part").select("p_partkey", tr.well_formed_code(code).alias("ok"))


_W = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}0-9]+'), lambda x: x <> '')"


@query(f"WITH b AS (SELECT list_distinct({_W.format('lower(text)')}) AS q FROM benchmark WHERE item_id = 0), d AS (SELECT doc_id, {_W.format('lower(text)')} AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(list_intersect(list_distinct(ws), q)) / len(q), 6) END AS share FROM d, b")
def x18_query_precision(t: Tables) -> DataFrame:
    q = t("benchmark").where("item_id = 0").limit(1).select(F.array_distinct(tr.words(F.lower("text"))).alias("q"))
    d = t("documents").select("doc_id", tr.words(F.lower("text")).alias("ws")).join(F.broadcast(q))
    return d.select("doc_id", r6(tr.query_precision(F.col("q"), F.array().cast("array<string>"), F.col("ws"))).alias("share"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^\p{L}0-9])([0-9]|\p{L}*[0-9]|\p{Lu}\p{Ll}+)') AS distinctive FROM documents")
def x19_distinctive(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tr.distinctive(F.col("text")).alias("distinctive"))


@query(f"WITH b AS (SELECT list_distinct({_W.format('lower(text)')}) AS q FROM benchmark WHERE item_id = 1) SELECT doc_id, len(list_intersect({_W.format('lower(text)')}, q)) > 0 AS holds FROM documents, b")
def x20_containment(t: Tables) -> DataFrame:
    q = t("benchmark").where("item_id = 1").limit(1).select(F.array_distinct(tr.words(F.lower("text"))).alias("q"))
    return t("documents").join(F.broadcast(q)).select("doc_id", F.arrays_overlap("q", tr.words(F.lower("text"))).alias("holds"))


_SPANS = "SELECT doc_id, CASE WHEN n <= 20 THEN 1 WHEN (n - 20) // 10 + 1 <= 8 THEN (n - 20) // 10 + 1 ELSE 8 END AS n_spans FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n FROM documents) WHERE n > 0"


@query(_SPANS)
def x07_spanner(t: Tables) -> DataFrame:
    ws = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r]+"), F.lit(0))
    d = t("documents").select("doc_id", ws.alias("ws")).where(F.size("ws") > 0)
    return d.select("doc_id", F.size(tr.span_starts(F.size("ws"), 20, 2, 8)).cast("long").alias("n_spans"))


@query()
def x06_chunks(t: Tables) -> DataFrame:
    return tr.chunked(t("documents"), 800, 100)


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS canonical FROM events")
def y03_canonical_json(t: Tables) -> DataFrame:
    return t("events").select("event_id", tr.canonical_json({"user": F.col("user_id"), "type": F.col("event_type"), "k": F.get_json_object("props", "$.k").cast("long")}).alias("canonical"))


@query("SELECT o_orderkey, '[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]' AS literal, 2 AS n FROM orders")
def y01_array_literal(t: Tables) -> DataFrame:
    a = F.array("o_orderstatus", "o_orderpriority")
    return t("orders").select("o_orderkey", F.to_json(a).alias("literal"), F.size(a).alias("n"))


_CONVICT = "regexp_matches(lower(text), '(^|[^a-z])(no longer|not anymore|instead of|used to|actually|changed|correction|wrong)([^a-z]|$)')"


@query(f"SELECT conv_id, turn, {_CONVICT} AS cue FROM conversations")
def z13_conflict_cues(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", tr.conflict_cue(F.col("text")).alias("cue"))
