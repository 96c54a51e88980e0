"""Queries by operator id, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import schema
from lodestone.functions import scalars as sc
from lodestone.operators import datasets as ds
from lodestone.operators import mining, search, statistics, temporal
from lodestone.operators import predicates as pr
from lodestone.plans.registry import ORACLES, QUERIES, Tables, query, r6

R = "WITH " + schema.RECORDS_SQL

# --- sources, scans and datasets


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_quantity < 45 AND l_returnflag IN ('A','R') ORDER BY l_orderkey DESC, l_linenumber LIMIT 50 OFFSET 10")
def s01_scan(t: Tables) -> DataFrame:
    where = pr.all_of(F.col("l_quantity") >= 30, F.col("l_quantity") < 45, pr.one_of("l_returnflag", ["A", "R"]))
    return ds.scan(t("lineitem"), where, ["l_orderkey", "l_linenumber", "l_quantity"], [F.col("l_orderkey").desc(), F.col("l_linenumber")], 50, 10)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def s04_count(t: Tables) -> DataFrame:
    return t("orders").where(pr.eq("o_orderstatus", "F")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0")
def s06_upsert(t: Tables) -> DataFrame:
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    return ds.upserted(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def s07_update(t: Tables) -> DataFrame:
    return ds.updated(t("orders"), pr.eq("o_orderstatus", "O"), {"o_totalprice": F.lit(0.0)}).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def s08_delete(t: Tables) -> DataFrame:
    return ds.deleted(t("orders"), F.col("o_totalprice") > 100000).select("o_orderkey")


@query(R + " SELECT doc_id FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN filed_at + INTERVAL 10 DAY END AS gone FROM r) WHERE filed_at <= TIMESTAMP '2024-01-15' AND (gone IS NULL OR gone > TIMESTAMP '2024-01-15')")
def s09_as_of(t: Tables) -> DataFrame:
    r = schema.records(t("documents")).withColumn("gone", F.when(F.col("doc_id") % 3 == 0, F.timestamp_add("DAY", F.lit(10), "filed_at")))
    return ds.visible_at(r, F.lit("2024-01-15").cast("timestamp_ntz"), "filed_at", "gone").select("doc_id")


_ROW = "o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority"


@query(f"SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5({_ROW}), 1, 15) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS digest FROM orders")
def s25_inventory(t: Tables) -> DataFrame:
    return ds.inventory(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


# --- predicates over packed fields

_FILTERS = {
    "currently_believe": ((), "(adjective & 63) >> 4 = 0"),
    "used_to_believe": ((), "(adjective & 63) >> 4 = 1"),
    "knew_once_and_erased": ((), "(adjective & 63) >> 4 = 2"),
    "state": ((16,), "adjective & 63 = 16"),
    "state_in_cluster": ((1,), "(adjective & 63) >> 4 = 1"),
    "trustworthy": ((), "(adjective >> 18) & 63 < 4"),
    "requires_confirmation": ((), "(adjective >> 18) & 63 >= 4"),
    "trust": ((2,), "(adjective >> 18) & 63 = 2"),
    "trust_at_most": ((2,), "(adjective >> 18) & 63 <= 2"),
    "sensitivity": ((32,), "(adjective >> 6) & 63 = 32"),
    "sensitivity_at_most": ((16,), "(adjective >> 6) & 63 <= 16"),
    "exportable": ((), "(adjective >> 12) & 63 = 32"),
    "contained": ((), "(adjective >> 12) & 63 = 0"),
    "user_confirmed": ((), "(provenance >> 18) & 63 >= 1"),
    "automated_confirmed_only": ((), "(provenance >> 18) & 63 = 2"),
    "unconfirmed": ((), "(provenance >> 18) & 63 = 0"),
    "source_type": ((3,), "provenance & 63 = 3"),
    "channel": ((1,), "(provenance >> 6) & 63 = 1"),
    "confidence_at_least": ((28,), "(provenance >> 24) & 63 >= 28"),
    "capture_channel": ((4,), "operational & 63 = 4"),
    "content_kind": ((5,), "(operational >> 6) & 63 = 5"),
    "has_feature_flag": ((1 << 14,), "operational & 16384 <> 0"),
    "in_room": (("fr",), "room = 'fr'"),
    "in_wing": (("src3",), "wing = 'src3'"),
    "content_matches": (("ent",), "contains(text, 'ent')"),
    "anomalous": ((True,), "operational & 67108864 <> 0"),
}
for _name, (_args, _sql) in _FILTERS.items():
    QUERIES[f"f18_{_name}"] = lambda spark, sf_dir, n=_name, a=_args: schema.records(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(pr.FILTERS[n](*a)).select("doc_id", "adjective", "operational", "provenance")
    ORACLES[f"f18_{_name}"] = f"{R} SELECT doc_id, adjective, operational, provenance FROM r WHERE {_sql}"
for _tier, _sql in {"currentAndVague": "operational & 2097152 = 0", "vagueOnly": "operational & 1048576 <> 0", "currentOnly": "operational & 3145728 = 0", "all": "true"}.items():
    QUERIES[f"f18_recall_tier_{_tier}"] = lambda spark, sf_dir, x=_tier: schema.records(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(pr.recall_tier(x)).select("doc_id")
    ORACLES[f"f18_recall_tier_{_tier}"] = f"{R} SELECT doc_id FROM r WHERE {_sql}"
for _name, (_p, _sql) in {
    "f08_like": (lambda: pr.like("text", "%the%"), "text LIKE '%the%'"),
    "f08_like_ignore_case": (lambda: pr.like("text", "the%", True), "text ILIKE 'the%'"),
    "f09_mask_all": (lambda: pr.mask_all("operational", 5), "operational & 5 = 5"),
    "f10_mask_any": (lambda: pr.mask_any("operational", 5), "operational & 5 <> 0"),
    "f11_mask_none": (lambda: pr.mask_none("operational", 5), "operational & 5 = 0"),
    "f12_mask_equals": (lambda: pr.mask_equals("adjective", 63, 17), "adjective & 63 = 17"),
    "f01_and_or_not": (lambda: pr.negated(pr.any_of(pr.eq("room", "en"), pr.all_of(pr.ne("wing", "src1"), F.col("n_chars") < 900))), "NOT (room = 'en' OR (wing <> 'src1' AND n_chars < 900))"),
    "f25_forbidden": (lambda: pr.forbidden(), "(adjective >> 6) & 63 = 48 AND (adjective >> 12) & 63 = 32"),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, p=_p: schema.records(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(p()).select("doc_id")
    ORACLES[_name] = f"{R} SELECT doc_id FROM r WHERE {_sql}"


@query(R + " SELECT doc_id FROM r WHERE room = 'en' AND (adjective & 63) >> 4 = 0 AND (adjective >> 18) & 63 < 4 AND (adjective >> 6) & 63 <= 16 AND operational & 2097152 = 0")
def f19_default_filters(t: Tables) -> DataFrame:
    return schema.records(t("documents")).where(pr.chain(("in_room", ("en",)))).select("doc_id")


@query(R + " SELECT doc_id, (adjective >> 18) & 63 AS trust, (provenance >> 24) & 63 AS confidence, (adjective & ~63) | 33 AS buried FROM r")
def f23_bit_fields(t: Tables) -> DataFrame:
    r = schema.records(t("documents"))
    return r.select("doc_id", schema.TRUST.value().alias("trust"), schema.CONFIDENCE.value().alias("confidence"), schema.STATE.written(F.lit(33)).alias("buried"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS page, (row_number() OVER (ORDER BY doc_id) - 1) // 50 = (count(*) OVER () - 1) // 50 AS is_last FROM documents")
def f28_paging(t: Tables) -> DataFrame:
    return ds.paged(t("documents").select("doc_id"), [F.col("doc_id")])


# --- joins

_FP = ", ".join(f"CAST('0x' || substr(md5(coalesce(text, '') || '{i}'), 1, 15) AS BIGINT) AS b{i}" for i in range(4))
_FP_SQL = f"WITH f AS (SELECT doc_id, lang, source, {_FP} FROM documents)"
_B = [f"b{i}" for i in range(4)]


def fingerprints(documents: DataFrame) -> DataFrame:
    """Four long blocks of 60 digest bits a document."""
    block = lambda i: F.conv(F.substring(F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit(str(i))).cast("binary")), 1, 15), 16, 10).cast("long").alias(f"b{i}")
    return documents.select("doc_id", "lang", "source", *(block(i) for i in range(4)))


@query("""WITH a AS (SELECT o_custkey AS item, row_number() OVER (ORDER BY o_totalprice DESC, o_custkey) AS rank FROM (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) ORDER BY rank LIMIT 40),
b AS (SELECT o_custkey AS item, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY rank LIMIT 40)
SELECT item, round(sum(mass), 9) AS score, CAST(bit_or(lane) AS BIGINT) AS lanes FROM (SELECT item, 0.6 / (60 + rank) AS mass, 1 AS lane FROM a UNION ALL SELECT item, 0.4 / (60 + rank), 2 FROM b) GROUP BY 1""")
def j01_rank_fusion(t: Tables) -> DataFrame:
    o = t("orders").groupBy(F.col("o_custkey").alias("item")).agg(F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))
    lane = lambda c: search.ranked(search.top(o, c, 40, "item"), c, "item")
    return search.fused({"price": (lane("high"), 0.6), "count": (lane("n"), 0.4)}, "item").select("item", F.round("score", 9).alias("score"), F.col("lanes").cast("long").alias("lanes"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j09_semi_join(t: Tables) -> DataFrame:
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j11_anti_join(t: Tables) -> DataFrame:
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH e AS (SELECT user_id, event_type AS v, epoch_us(ts) / 1000000.0 AS t FROM events), p AS (
SELECT a.v AS source, b.v AS target, (b.t - a.t) / 60 AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t - a.t < 256 * 60)
SELECT source, target, least(128, CAST(pow(2, ceil(log2(greatest(gap, 1.0)))) AS INTEGER)) AS lag, count(*) AS n FROM p GROUP BY ALL""")
def j07_lag_pairs(t: Tables) -> DataFrame:
    return temporal.lag_pairs(t("events"), "ts", "event_type", ["user_id"])


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem)
SELECT a.l_partkey AS part, a.l_orderkey AS a_order, a.l_linenumber AS a_line, b.l_orderkey AS b_order, b.l_linenumber AS b_line FROM f a JOIN f b ON a.l_partkey = b.l_partkey AND a.l_returnflag <> b.l_returnflag AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber)""")
def j08_conflict_pairs(t: Tables) -> DataFrame:
    f = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a, b = f.toDF("a_order", "a_line", "part", "fa"), f.toDF("b_order", "b_line", "part", "fb")
    return a.join(b, "part").where((F.col("fa") != F.col("fb")) & (F.struct("a_order", "a_line") < F.struct("b_order", "b_line"))).select("part", "a_order", "a_line", "b_order", "b_line")


@query("""SELECT event_id, (SELECT min(m.ts) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'purchase' AND m.ts >= e.ts) AS marker_ts FROM events e WHERE event_type = 'click'""")
def j15_first_marker(t: Tables) -> DataFrame:
    e = t("events")
    return temporal.first_after(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'"), "ts", ["user_id"]).select("event_id", "marker_ts")


# --- aggregations


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM lineitem" for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")))
def a01_column_statistics(t: Tables) -> DataFrame:
    return ds.column_statistics(t("lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query(R + " SELECT column_name, CAST(i // 6 AS INTEGER) AS field, CAST(i % 6 AS INTEGER) AS field_bit, CAST(sum((v >> i) & 1) AS BIGINT) AS n FROM (SELECT 'adjective' AS column_name, adjective AS v FROM r UNION ALL SELECT 'operational', operational FROM r UNION ALL SELECT 'provenance', provenance FROM r), range(60) x(i) GROUP BY ALL")
def a03_field_presence(t: Tables) -> DataFrame:
    return mining.field_presence(schema.records(t("documents")), ["adjective", "operational", "provenance"])


_ITEMS = "SELECT row, unnest(['l_returnflag:' || l_returnflag, 'l_linestatus:' || l_linestatus, 'l_linenumber:' || l_linenumber]) AS item FROM (SELECT *, row_number() OVER () AS row FROM lineitem)"
_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(f"WITH i AS ({_ITEMS}) SELECT a.item AS a, b.item AS b, count(*) AS n FROM i a JOIN i b USING (row) GROUP BY ALL")
def a05_cooccurrence(t: Tables) -> DataFrame:
    return mining.cooccurrence(t("lineitem"), _COLS)


@query(_FP_SQL + " SELECT lang, " + ", ".join(f"bit_or({b}) AS or_{b}, bit_xor({b}) AS xor_{b}, bit_and({b}) AS and_{b}" for b in _B) + " FROM f GROUP BY lang")
def a07_fingerprint_reduce(t: Tables) -> DataFrame:
    return fingerprints(t("documents")).groupBy("lang").agg(*(x for b in _B for x in (F.bit_or(b).alias(f"or_{b}"), F.bit_xor(b).alias(f"xor_{b}"), F.bit_and(b).alias(f"and_{b}"))))


@query(_FP_SQL + " SELECT lang, CAST(i AS INTEGER) AS bit, CAST(sum((b0 >> i) & 1) AS BIGINT) AS n, CAST(sum((b0 >> i) & 1) * 2 > count(*) AS INTEGER) AS majority, round(avg((b0 >> i) & 1), 6) AS share FROM f, range(60) x(i) GROUP BY lang, i")
def a08_bit_counts(t: Tables) -> DataFrame:
    sums = fingerprints(t("documents")).groupBy("lang").agg(F.count(F.lit(1)).alias("total"), *(F.sum(F.shiftright("b0", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(60)))
    long = sums.select("lang", "total", F.posexplode(F.array(*(f"s{i}" for i in range(60)))).alias("bit", "n"))
    return long.select("lang", "bit", "n", (F.col("n") * 2 > F.col("total")).cast("int").alias("majority"), r6(F.col("n") / F.col("total")).alias("share"))


@query("SELECT user_id, CAST(floor(epoch_us(ts) / 1000000.0 / 3600) AS BIGINT) AS bucket, bit_or(event_id) AS mask, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def a13_compress(t: Tables) -> DataFrame:
    return temporal.compressed(t("events"), "ts", "hour", "event_id", ["user_id"])


@query("SELECT CAST(floor(epoch_us(ts) / 1000000.0 / 604800) AS BIGINT) AS bucket, bit_or(event_id) AS mask, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def a14_rollup(t: Tables) -> DataFrame:
    return temporal.rolled_up(temporal.compressed(t("events"), "ts", "day", "event_id"), 7)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM events GROUP BY 1")
def a17_current_state(t: Tables) -> DataFrame:
    return temporal.fold(t("events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM events WHERE ts <= (SELECT quantile_disc(ts, 0.5) FROM events) GROUP BY 1")
def a18_state_as_of(t: Tables) -> DataFrame:
    e = t("events")
    half = e.agg(F.percentile_disc(F.lit(0.5), "ts").alias("half")) if hasattr(F, "percentile_disc") else e.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(ts as timestamp))) AS half")
    kept = e.join(F.broadcast(half)).where(F.unix_micros(F.col("ts").cast("timestamp")) <= F.col("half"))
    return temporal.fold(kept, "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT event_id, ts, user_id FROM events WHERE event_id % 3 <> 0 UNION SELECT event_id, ts, user_id FROM events WHERE event_id % 2 = 0")
def a20_log_union(t: Tables) -> DataFrame:
    e = t("events").select("event_id", "ts", "user_id")
    return temporal.merged_logs(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0"), ["event_id"])


_WILSON = "(p + 3.8416 / (2 * trials) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * trials)) / trials)) / (1 + 3.8416 / trials)"


@query(f"SELECT l_returnflag, l_linestatus, trials, successes, round({_WILSON}, 6) AS lower FROM (SELECT *, successes / trials AS p FROM (SELECT l_returnflag, l_linestatus, count(*) AS trials, CAST(sum(CAST(l_discount > 0.05 AS INT)) AS BIGINT) AS successes FROM lineitem GROUP BY 1, 2))")
def a24_wilson(t: Tables) -> DataFrame:
    return statistics.outcomes(t("lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount") > 0.05).withColumn("lower", r6("lower"))


_CAL = "WITH h AS (SELECT CAST(least(19, floor(l_discount * 10 * 20)) AS INTEGER) AS bin, count(*) AS n, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS hits FROM lineitem GROUP BY 1)"


@query(_CAL + " SELECT * FROM h")
def a25_calibration(t: Tables) -> DataFrame:
    return statistics.calibration(t("lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query(_CAL + " SELECT round(sum(abs(hits / n - (bin + 0.5) / 20) * n) / sum(n), 6) AS ece, round(sum(pow(hits / n - (bin + 0.5) / 20, 2) * n) / sum(n), 6) AS brier FROM h")
def a26_calibration_errors(t: Tables) -> DataFrame:
    out = statistics.calibration_errors(statistics.calibration(t("lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R"))
    return out.select(r6("ece").alias("ece"), r6("brier").alias("brier"))


@query("SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY lang)")
def a28_entropy(t: Tables) -> DataFrame:
    return statistics.entropy(t("documents"), "lang").select(r6("entropy").alias("entropy"))


@query("""WITH j AS (SELECT l_returnflag a, l_linestatus b, count(*) n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) t FROM j),
x AS (SELECT -sum(n / t * log2(n / t)) h FROM (SELECT a, sum(n) n FROM j GROUP BY 1), t), y AS (SELECT -sum(n / t * log2(n / t)) h FROM (SELECT b, sum(n) n FROM j GROUP BY 1), t), z AS (SELECT -sum(n / t * log2(n / t)) h FROM j, t)
SELECT round(x.h, 6) AS h_a, round(y.h, 6) AS h_b, round(z.h, 6) AS h_ab, round(x.h + y.h - z.h, 6) AS mi, round(2 * (x.h + y.h - z.h) / (x.h + y.h), 6) AS nmi FROM x, y, z""")
def a29_mutual_information(t: Tables) -> DataFrame:
    out = statistics.mutual_information(t("lineitem"), "l_returnflag", "l_linestatus")
    return out.select(*(r6(c).alias(c) for c in out.columns))


_PQ = "WITH a AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) + {s} AS a, count(*) FILTER (user_id % 2 = 1) + {s} AS b FROM events GROUP BY 1), x AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM a)"
_DIV = " SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END), 6) AS kl, round(sum(CASE WHEN p > 0 AND q > 0 THEN -p * log2(q) ELSE 0 END), 6) AS cross_entropy, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS js FROM x"


def _drift(t: Tables, smoothing: float) -> DataFrame:
    e = t("events")
    out = statistics.divergences(statistics.aligned(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), "event_type", smoothing))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query(_PQ.format(s="0") + _DIV)
def a30_divergence(t: Tables) -> DataFrame:
    return _drift(t, 0.0)


@query(_PQ.format(s="0.5") + _DIV)
def q24_drift(t: Tables) -> DataFrame:
    return _drift(t, 0.5)


@query("WITH c AS (SELECT lang, sum(exp(-ln(2) * doc_id / 500.0)) AS w, count(*) AS n FROM documents GROUP BY 1) SELECT lang, round(w / sum(w) OVER () - n / sum(n) OVER (), 6) AS momentum FROM c")
def a39_momentum(t: Tables) -> DataFrame:
    return statistics.momentum(t("documents"), "lang", F.exp(-F.lit(0.6931471805599453) * F.col("doc_id") / 500.0)).withColumn("momentum", r6("momentum"))


@query("SELECT source AS wing, count(*) AS n, count(DISTINCT lang) AS rooms FROM documents GROUP BY 1")
def a41_wing_summary(t: Tables) -> DataFrame:
    return schema.records(t("documents")).groupBy("wing").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("room").alias("rooms"))


@query(f"WITH i AS ({_ITEMS}), o AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM i a JOIN i b USING (row) GROUP BY ALL), m AS (SELECT a AS i, n AS ni FROM o WHERE a = b) SELECT a, b, round(log2(o.n * CAST((SELECT count(*) FROM lineitem) AS DOUBLE) / (x.ni * y.ni)), 6) AS pmi FROM o JOIN m x ON x.i = a JOIN m y ON y.i = b WHERE a < b")
def a46_pmi(t: Tables) -> DataFrame:
    li = t("lineitem")
    return mining.pmi(mining.cooccurrence(li, _COLS), li.count()).withColumn("pmi", r6("pmi"))


_TOK = r"list_filter(regexp_split_to_array(replace(lower(text), 'ς', 'σ'), '[^\p{L}0-9]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents) SELECT term, count(*) AS df, round(greatest(0.0, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1))), 6) AS idf FROM w GROUP BY 1")
def a49_document_frequency(t: Tables) -> DataFrame:
    d = t("documents")
    n = d.agg(F.count(F.lit(1)).alias("n_docs"))
    df = d.select(F.explode(F.array_distinct(sc.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", r6(F.greatest(F.lit(0.0), F.log((F.col("n_docs") + 1) / (F.col("df") + 1)))).alias("idf"))


_LEAF = "SELECT lang, doc_id AS k, sha256(doc_id || ':' || coalesce(text, '')) AS h FROM documents"
_LEVEL = "SELECT lang, k // 256 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM ({}) GROUP BY lang, k // 256"


@query(f"SELECT lang, sha256(string_agg(h, '' ORDER BY k)) AS root FROM ({_LEVEL.format(_LEVEL.format(_LEVEL.format(_LEAF)))}) GROUP BY lang")
def a51_merkle(t: Tables) -> DataFrame:
    """A tree of fan-in 256, so no group grows with the table until the root has 2**24 documents below each child."""
    level = t("documents").select("lang", F.col("doc_id").alias("k"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("h"))
    rolled = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256)
    for _ in range(3):
        level = level.groupBy("lang", F.expr("k div 256").alias("parent")).agg(rolled.alias("h")).withColumnRenamed("parent", "k")
    return level.groupBy("lang").agg(rolled.alias("root"))


# --- windows


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def w01_rank_in_lane(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")).alias("rank"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled FROM part")
def w02_min_max(t: Tables) -> DataFrame:
    return statistics.min_max(t("part"), "p_retailprice").select("p_partkey", r6("scaled").alias("scaled"))


@query("SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w < 1e-9 THEN 0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 4) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def w03_rolling_z(t: Tables) -> DataFrame:
    return statistics.rolling_z(t("events"), ["user_id"], ["ts", "event_id"], "value", 9).select("event_id", F.round("z", 4).alias("z"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1), m AS (SELECT event_type, v[len(v) // 2 + 1] AS med FROM s),
d AS (SELECT event_type, list_sort(list(abs(value - med))) AS v FROM events JOIN m USING (event_type) GROUP BY 1), x AS (SELECT event_type, v[len(v) // 2 + 1] AS mad FROM d)
SELECT event_id, round(CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (value - med) / mad END, 6) AS z FROM events JOIN m USING (event_type) JOIN x USING (event_type)""")
def w04_modified_z(t: Tables) -> DataFrame:
    return statistics.modified_z(t("events"), ["event_type"], "value").select("event_id", r6("z").alias("z"))


@query("SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s FROM events) WHERE s >= 1e-6 AND abs((value - m) / s) >= 3")
def w06_anomalies(t: Tables) -> DataFrame:
    return statistics.z_scores(t("events"), ["event_type"], "value").where("abs(z) >= 3").select("event_id")


@query("""WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), g AS (SELECT user_id, count(*) AS n, count(*) FILTER (d > 0) AS ups, count(*) FILTER (d < 0) AS downs, avg(d) AS slope FROM d GROUP BY 1)
SELECT user_id, n, ups, downs, round(coalesce(slope, 0), 6) AS slope, CASE WHEN ups = 0 AND downs = 0 THEN 'static' WHEN ups = 0 OR downs = 0 THEN 'monotone' WHEN abs(ups - downs) <= 1 THEN 'oscillating' ELSE 'divergent' END AS trajectory FROM g""")
def w08_trajectory(t: Tables) -> DataFrame:
    return temporal.trajectories(t("events"), ["user_id"], ["ts", "event_id"], "value").withColumn("slope", r6("slope"))


@query("""WITH e AS (SELECT CAST(floor(epoch_us(ts) / 1000000.0 / 86400) AS BIGINT) AS bucket FROM events), m AS (SELECT max(bucket) AS hi FROM e) SELECT x.b AS bucket, count(e.bucket) AS n FROM (SELECT unnest(range(hi - 29, hi + 1)) AS b FROM m) x LEFT JOIN e ON e.bucket = x.b GROUP BY 1""")
def r11_bucket_series(t: Tables) -> DataFrame:
    e = t("events")
    hi = e.agg(F.max(temporal.bucket("ts", "day"))).first()[0]
    return temporal.bucket_series(e, "ts", "day", hi, 30)


# --- top-k and similarity


@query(_FP_SQL + ", p AS (SELECT b0 AS q0, b1 AS q1, b2 AS q2, b3 AS q3 FROM f WHERE doc_id = 0) SELECT doc_id, CAST(bit_count(xor(b0, q0)) AS BIGINT) + bit_count(xor(b1, q1)) + bit_count(xor(b2, q2)) + bit_count(xor(b3, q3)) AS distance FROM f, p ORDER BY distance, doc_id LIMIT 20")
def t02_hamming_top_k(t: Tables) -> DataFrame:
    f = fingerprints(t("documents"))
    probe = f.where("doc_id = 0").select(*(F.col(b).alias(f"q{b[1]}") for b in _B))
    near = search.probe_distances(f, probe, sc.hamming(_B, [f"q{i}" for i in range(4)]).cast("long"))
    return search.top(near, "distance", 20, "doc_id", descending=False).select("doc_id", "distance")


@query(_FP_SQL + ", p AS (SELECT b0 AS q0, b1 AS q1, b2 AS q2, b3 AS q3 FROM f WHERE doc_id = 0) SELECT doc_id FROM f, p WHERE CAST(bit_count(xor(b0, q0)) AS BIGINT) + bit_count(xor(b1, q1)) + bit_count(xor(b2, q2)) + bit_count(xor(b3, q3)) <= 110")
def t05_radius(t: Tables) -> DataFrame:
    f = fingerprints(t("documents"))
    probe = f.where("doc_id = 0").select(*(F.col(b).alias(f"q{b[1]}") for b in _B))
    return search.probe_distances(f, probe, sc.hamming(_B, [f"q{i}" for i in range(4)])).where("distance <= 110").select("doc_id")


_BM = f"""WITH d AS (SELECT doc_id, {_TOK} AS ws FROM documents), z AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d), p AS (SELECT doc_id, len(ws) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN ('the', 'and', 'idiot', 'version') GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1), b AS (SELECT doc_id, CAST(sum(round_even(100 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)), 0)) AS BIGINT) AS score FROM p JOIN dfs USING (term), z GROUP BY 1)"""
_QUERY = ("the", "and", "idiot", "version")


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(p.embedding[i] AS DOUBLE)))"


@query(f"WITH p AS (SELECT vec_id AS probe, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT p.probe, e.vec_id, {_COS} / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(p.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS c FROM embeddings e, p), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY c DESC, vec_id) AS rank FROM s) SELECT probe, vec_id, rank, round(c, 6) AS cosine FROM r WHERE rank <= 10")
def d18_cosine_top_k(t: Tables) -> DataFrame:
    e = t("embeddings")
    probes = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("q"))
    near = search.cosine_top_k(e, probes, 10)
    return near.select("probe", "vec_id", F.col("rank").cast("long").alias("rank"), r6("cosine").alias("cosine"))


@query("SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127, 9) AS scale, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / (list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))) / 127)) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def d20_int8(t: Tables) -> DataFrame:
    q = t("embeddings").select("vec_id", sc.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query()
def t09_diversified(t: Tables) -> DataFrame:
    e = t("embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    pool = e.where("vec_id <> 0").join(F.broadcast(probe)).select("vec_id", "embedding", sc.cosine(F.col("embedding"), F.col("q")).alias("relevance"))
    return search.diversified(pool, 20, 0.7)


# --- text and scalar functions


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, array_to_string(list_slice({_TOK}, 1, 5), ' ') AS head FROM documents")
def x01_tokens(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", sc.tokens(F.col("text")).alias("ws")).select("doc_id", F.size("ws").cast("long").alias("n_tokens"), F.array_join(F.slice("ws", 1, 5), " ").alias("head"))


@query("SELECT item_id, CAST(len(list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(lower(text), i, 3)))) AS BIGINT) AS n FROM benchmark")
def x08_shingles(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.size(sc.shingles(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\S+')) = 0 THEN 0 ELSE (3 * strlen(text) + 16 * len(regexp_extract_all(text, '\S+')) + 12) // 24 END AS estimate FROM documents")
def x10_token_estimate(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", sc.token_estimate(F.col("text")).alias("estimate"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def x12_digest(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, CASE WHEN user_id & 255 > 127 THEN (user_id & 255) - 256 ELSE user_id & 255 END * 72057594037927936 + ((CAST(event_id & 65535 AS BIGINT) << 40) | ((epoch_us(ts) // 1000) & 1099511627775)) AS packed FROM events")
def d02_packed_clock(t: Tables) -> DataFrame:
    return t("events").select("event_id", sc.hlc_packed(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id").bitwiseAND(F.lit(65535)), F.col("user_id")).alias("packed"))


@query("SELECT a.n_name AS a, b.n_name AS b, round(least(1.0, (length(a.n_name) - l + length(b.n_name) - l) / greatest(length(a.n_name), length(b.n_name), 1)), 6) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey, LATERAL (SELECT coalesce(list_max(list_filter(range(0, least(length(a.n_name), length(b.n_name)) + 1), lambda i: left(a.n_name, CAST(i AS BIGINT)) = left(b.n_name, CAST(i AS BIGINT)))), 0) AS l)")
def d23_code_distance(t: Tables) -> DataFrame:
    n = t("nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("i < j").select("a", "b", r6(sc.code_distance(F.col("a"), F.col("b"))).alias("distance"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def y02_json_field(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- rules, concepts, graphs


@query(f"WITH i AS ({_ITEMS}), o AS (SELECT a.item AS a, b.item AS b, count(*) AS n FROM i a JOIN i b USING (row) GROUP BY ALL), m AS (SELECT a AS i, n AS ni FROM o WHERE a = b), t AS (SELECT count(*) AS t FROM lineitem) SELECT a AS antecedent, b AS consequent, round(n / t, 6) AS support, round(n / x.ni, 6) AS confidence, round((n / x.ni) / (y.ni / t), 6) AS lift, round(n / t - (x.ni / t) * (y.ni / t), 6) AS leverage, round(CASE WHEN n < x.ni THEN (1 - y.ni / t) / (1 - n / x.ni) END, 6) AS conviction FROM o JOIN m x ON x.i = a JOIN m y ON y.i = b, t WHERE a <> b AND n / t >= 0.01")
def g09_rules(t: Tables) -> DataFrame:
    li = t("lineitem")
    out = mining.rules(mining.cooccurrence(li, _COLS), li.count(), 0.01)
    return out.select("antecedent", "consequent", *(r6(c).alias(c) for c in out.columns[2:]))


@query(f"WITH i AS ({_ITEMS}), t AS (SELECT count(*) AS t FROM lineitem), r AS (SELECT row, list_sort(list(item)) AS v FROM i GROUP BY 1), s AS (SELECT v AS x, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT [v[a], v[b]], count(*) FROM r, (VALUES (1,2),(1,3),(2,3)) p(a, b) GROUP BY 1 UNION ALL SELECT [item], count(*) FROM i GROUP BY 1), k AS (SELECT x, n FROM s, t WHERE n >= ceil(0.05 * t)) SELECT array_to_string(list_filter(k.x, lambda z: z <> c.c), '&') AS antecedent, c.c AS consequent, round(k.n / t, 6) AS support, round(k.n / f.n, 6) AS confidence, round((k.n / f.n) / (o.n / t), 6) AS lift FROM k, LATERAL (SELECT unnest(k.x) AS c) c, t, k f, k o WHERE len(k.x) > 1 AND f.x = list_filter(k.x, lambda z: z <> c.c) AND o.x = [c.c]")
def g10_itemset_rules(t: Tables) -> DataFrame:
    out = mining.itemset_rules(t("lineitem"), _COLS, 0.05)
    return out.select("antecedent", "consequent", *(r6(c).alias(c) for c in ("support", "confidence", "lift")))


@query("""WITH m AS (SELECT median(l_quantity) AS a, median(l_extendedprice) AS b FROM lineitem), d AS (SELECT median(abs(l_quantity - a)) AS da, median(abs(l_extendedprice - b)) AS db FROM lineitem, m), f AS (SELECT l_returnflag, -log2(count(*) / sum(count(*)) OVER ()) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(abs(l_quantity - a) / (1.4826 * da) + abs(l_extendedprice - b) / (1.4826 * db) + s, 6) AS score FROM lineitem JOIN f USING (l_returnflag), m, d""")
def g13_cohesion(t: Tables) -> DataFrame:
    out = statistics.cohesion(t("lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", r6("score").alias("score"))


@query("WITH o AS (SELECT o_custkey AS c, list_distinct(list(o_orderpriority)) AS items FROM orders GROUP BY 1), x AS (SELECT * FROM o WHERE list_contains(items, '1-URGENT') AND list_contains(items, '5-LOW')), n AS (SELECT count(*) AS support FROM x), i AS (SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM x) GROUP BY 1) SELECT support, string_agg(item, ',' ORDER BY item) AS closure FROM i, n WHERE n = support GROUP BY 1")
def g14_closure(t: Tables) -> DataFrame:
    tx = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("items"))
    return mining.closure(tx, ["1-URGENT", "5-LOW"]).select("support", F.array_join("closure", ",").alias("closure"))


def _trade(t: Tables) -> DataFrame:
    """Suppliers linked through the parts of one order."""
    return mining.sharing(t("lineitem"), "l_orderkey", "l_suppkey")


@query()
def g01_centrality(t: Tables) -> DataFrame:
    return mining.eigenvector(mining.adjacency(_trade(t)), 6).select("id", r6("x").alias("centrality"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT a.s AS src, b.s AS dst FROM l a JOIN l b ON a.o = b.o AND a.s <> b.s), r AS (SELECT DISTINCT src AS id, src AS seen FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON r.seen = e.src) SELECT id, min(seen) AS community FROM r GROUP BY 1""")
def g05_communities(t: Tables) -> DataFrame:
    return mining.communities(_trade(t))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT a.s AS src, b.s AS dst FROM l a JOIN l b ON a.o = b.o AND a.s <> b.s), r AS (SELECT (SELECT min(src) FROM e) AS id, 0 AS hop UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON r.id = e.src WHERE r.hop < 3) SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1""")
def j16_neighbourhood(t: Tables) -> DataFrame:
    e = mining.cut(_trade(t))
    return mining.neighbourhood(e, e.agg(F.min("src").alias("id")), 3)


# --- streams and conflict resolution


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def r23_last_writer(t: Tables) -> DataFrame:
    e = t("events").select("user_id", "event_id", "value", "ts")
    return ds.last_writer(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(event_type, (ts, event_id)) FILTER (event_type IS NOT NULL) AS event_type FROM events GROUP BY 1")
def r25_field_last_writer(t: Tables) -> DataFrame:
    return ds.field_last_writer(t("events"), ["user_id"], ["ts", "event_id"], ["value", "event_type"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r10_tumbling_stream(t: Tables) -> DataFrame:
    from lodestone.streaming.twins import hourly_counts

    return hourly_counts(t("events"))
