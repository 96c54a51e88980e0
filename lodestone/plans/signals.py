"""Queries over events, graphs and groups, and what standing jobs make of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import scalars as sc
from lodestone.operators import mining, signals, statistics
from lodestone.plans import measures  # noqa: F401  its queries are reused below
from lodestone.plans.catalog import _B, _FP_SQL, _TOK, fingerprints
from lodestone.plans.registry import ORACLES, QUERIES, Tables, query, r6

R = "WITH " + schema.RECORDS_SQL


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1000000


# --- joins and sets


@query("SELECT l_suppkey AS source, o_custkey AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j12_graph_edges(t: Tables) -> DataFrame:
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("source"), F.col("o_custkey").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_custkey AS concept FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def j10_lost(t: Tables) -> DataFrame:
    dropped = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("concept"))
    missing = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("concept"))
    return dropped.union(missing).distinct()


@query("SELECT estate, lang, n FROM (SELECT 'even' AS estate, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'odd', lang, count(*) FROM documents WHERE doc_id % 2 = 1 GROUP BY 2)")
def j14_estates(t: Tables) -> DataFrame:
    """The same read over several estates, each row with its estate: one union, then one aggregation for all."""
    d = t("documents")
    estates = [d.where(F.col("doc_id") % 2 == i).select(F.lit(name).alias("estate"), "lang") for i, name in enumerate(("even", "odd"))]
    return estates[0].unionByName(estates[1]).groupBy("estate", "lang").agg(F.count(F.lit(1)).alias("n"))


QUERIES["q37_cross_estate"], ORACLES["q37_cross_estate"] = QUERIES["j14_estates"], ORACLES["j14_estates"]


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def z14_recalled_together(t: Tables) -> DataFrame:
    """Pairs inside each session, whose members are few."""
    sessions = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("xs"))
    pairs = sessions.select("xs", F.posexplode("xs").alias("i", "a")).select("a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


_JS = "WITH c AS (SELECT lang, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY 1), x AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 6) AS js FROM x"


@query(_JS)
def u05_estate_divergence(t: Tables) -> DataFrame:
    d = t("documents")
    return statistics.divergences(statistics.aligned(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "lang", 0.0)).select(F.coalesce(r6("js"), F.lit(0.0)).alias("js"))


QUERIES["q31_estate_divergence"], ORACLES["q31_estate_divergence"] = QUERIES["u05_estate_divergence"], ORACLES["u05_estate_divergence"]


@query("SELECT CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'dropped' ELSE 'kept' END AS side, count(*) AS n FROM documents GROUP BY 1")
def u06_both_partitions(t: Tables) -> DataFrame:
    blank = ~F.coalesce(F.regexp_like("text", F.lit(r"[^ \t\n\r]")), F.lit(False))
    return t("documents").groupBy(F.when(blank, "dropped").otherwise("kept").alias("side")).agg(F.count(F.lit(1)).alias("n"))


# --- time


_GAPS = "e AS (SELECT user_id, event_id, event_type AS v, epoch_us(ts) / 1000000.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@query(f"WITH {_GAPS} SELECT a.v AS source, b.v AS target, CAST(floor(log2((b.s - a.s) / 60)) AS INTEGER) AS lag, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.r - a.r BETWEEN 1 AND 512 AND (b.s - a.s) / 60 BETWEEN 1 AND 255 GROUP BY ALL")
def a06_temporal_matrix(t: Tables) -> DataFrame:
    return signals.lag_matrix(signals.recent_pairs(t("events"), "user_id", ["ts", "event_id"], _seconds("ts"), "event_type", 512, 256 * 60.0))


@query(f"WITH {_GAPS} SELECT a.v AS source, b.v AS target, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.r - a.r BETWEEN 1 AND 512 AND b.s > a.s AND b.s - a.s < 256 * 60 WHERE b.s > epoch_us(TIMESTAMP '2024-01-15') / 1000000.0 GROUP BY ALL")
def r09_fold_past_watermark(t: Tables) -> DataFrame:
    """Only events past the watermark are targets; older ones are sources still."""
    e = t("events").withColumn("both", F.struct("event_type", (F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).alias("new")))
    pairs = signals.recent_pairs(e, "user_id", ["ts", "event_id"], _seconds("ts"), "both", 512, 256 * 60.0).where("target.new")
    return pairs.groupBy(F.col("source.event_type").alias("source"), F.col("target.event_type").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GAPS} SELECT a.v AS source, b.v AS target, least(128, CAST(pow(2, ceil(log2(greatest((b.s - a.s) / 60, 1.0)))) AS INTEGER)) AS lag, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.r - a.r BETWEEN 1 AND 512 AND b.s > a.s AND b.s - a.s < 256 * 60 GROUP BY ALL")
def z01_causality_fold(t: Tables) -> DataFrame:
    pairs = signals.recent_pairs(t("events"), "user_id", ["ts", "event_id"], _seconds("ts"), "event_type", 512, 256 * 60.0)
    return pairs.groupBy("source", "target", sc.lag_bucket(F.col("gap")).alias("lag")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["r21_causality_signal"], ORACLES["r21_causality_signal"] = QUERIES["z01_causality_fold"], ORACLES["z01_causality_fold"]


@query("SELECT user_id, event_type AS field, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY 1, 2")
def a19_project_all(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("at"))


@query("SELECT user_id, event_type AS field, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def r12_late_events(t: Tables) -> DataFrame:
    """Two logs, one late and partly the same: their union folds to the state of the whole."""
    e = t("events")
    merged = e.where("event_id % 4 <> 0").unionByName(e.where("event_id % 2 = 0")).dropDuplicates(["event_id"])
    return merged.groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r13_incremental_matrix(t: Tables) -> DataFrame:
    """A stored matrix and the increments past its watermark are added; the whole log is not read again."""
    e, mark = t("events"), F.lit("2024-01-15").cast("timestamp_ntz")
    cells = lambda x: x.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    both = cells(e.where(F.col("ts") <= mark)).unionByName(cells(e.where(F.col("ts") > mark)))
    return both.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("""WITH d AS (SELECT user_id, event_type AS v, row_number() OVER w AS r, first_value(event_type) OVER w AS terminal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
g AS (SELECT user_id, count(*) AS n, any_value(terminal) AS terminal, min(r) FILTER (v <> terminal) AS other, max(v) FILTER (r = 1) AS t1, max(v) FILTER (r = 2) AS t2, max(v) FILTER (r = 3) AS t3, max(v) FILTER (r = 4) AS t4 FROM d GROUP BY 1)
SELECT user_id, n, terminal, round(CASE WHEN other IS NULL THEN 1 WHEN n >= 4 AND t1 = t3 AND t2 = t4 AND t1 <> t2 THEN 0 ELSE (other - 1) / n END, 6) AS score,
CASE WHEN other IS NULL THEN 'static' WHEN n >= 4 AND t1 = t3 AND t2 = t4 AND t1 <> t2 THEN 'oscillating' WHEN (other - 1) / n >= 0.5 THEN 'convergent' ELSE 'divergent' END AS trajectory FROM g""")
def w07_categorical_trajectory(t: Tables) -> DataFrame:
    return signals.categorical_trajectory(t("events"), "user_id", ["ts", "event_id"], "event_type").withColumn("score", r6("score"))


_AGE = "(epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0"
_RATE = "CASE event_type WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.2 WHEN 'purchase' THEN 0.5 ELSE 0.8 END"


def _typed(t: Tables) -> DataFrame:
    e = t("events")
    kind = F.when(F.col("event_type") == "click", "entity").when(F.col("event_type") == "view", "relation").when(F.col("event_type") == "purchase", "temporal").otherwise("numerical")
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", "user_id", "event_type", mining.weights_by_type(kind, age).alias("weight"))


@query(f"SELECT event_id, round(exp(-{_RATE} * {_AGE}), 6) AS weight FROM events")
def w09_typed_decay(t: Tables) -> DataFrame:
    return _typed(t).select("event_id", r6("weight").alias("weight"))


@query(f"SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN w ELSE 0 END) / sum(w), 6) AS share FROM (SELECT user_id, event_type, exp(-{_RATE} * {_AGE}) AS w FROM events) GROUP BY 1")
def w10_weighted_frequency(t: Tables) -> DataFrame:
    return _typed(t).groupBy("user_id").agg(r6(F.sum(F.when(F.col("event_type") == "purchase", F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))


@query(f"SELECT user_id, v >= 3.0 AS churning, first_type <> last_type AS reanchored, last_type AS anchor FROM (SELECT user_id, sum(exp(-0.1 * {_AGE})) AS v, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1)")
def w11_node_motion(t: Tables) -> DataFrame:
    e = t("events")
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000
    clock = F.struct("ts", "event_id")
    g = e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).groupBy("user_id").agg(F.sum(F.exp(-0.1 * age)).alias("v"), F.min_by("event_type", clock).alias("a"), F.max_by("event_type", clock).alias("anchor"))
    return g.select("user_id", (F.col("v") >= 3.0).alias("churning"), (F.col("a") != F.col("anchor")).alias("reanchored"), "anchor")


@query(R + ", h AS (SELECT max(CAST(floor(epoch_us(filed_at) / 86400000000.0) AS BIGINT)) AS hi FROM r), b AS (SELECT hi - 15 + i AS bucket FROM h, range(16) x(i)), s AS (SELECT CAST(floor(epoch_us(filed_at) / 86400000000.0) AS BIGINT) AS bucket, max((operational >> 20) & 1) AS present FROM r GROUP BY 1) SELECT b.bucket, CAST(coalesce(s.present, 0) AS BIGINT) AS present FROM b LEFT JOIN s USING (bucket)")
def w12_filled_bit_series(t: Tables) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("filed_at").cast("timestamp")) / 86400000000)
    r = schema.records(t("documents")).select(day.alias("bucket"), F.getbit("operational", F.lit(20)).cast("long").alias("bit"))
    held = r.groupBy("bucket").agg(F.max("bit").alias("present"))
    last = r.agg(F.max("bucket").alias("hi"))
    return last.select(F.explode(F.sequence(F.col("hi") - 15, F.col("hi"))).alias("bucket")).join(held, "bucket", "left").select("bucket", F.coalesce("present", F.lit(0).cast("long")).alias("present"))


# --- groups, walks, rankings

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings), c AS (SELECT a.label, a.vec_id, sum(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i]))) / count(*) AS cohesion FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2)"
_OUT = f"WITH {_UNIT}, m AS (SELECT label, avg(cohesion) AS m, stddev_pop(cohesion) AS d, count(*) AS n FROM c GROUP BY 1) SELECT label, vec_id, round(cohesion, 6) AS cohesion, n >= 3 AND d >= 1e-6 AND (cohesion - m) / d <= -1.5 AS outlier FROM c JOIN m USING (label)"


@query(_OUT)
def w13_cohesion_roster(t: Tables) -> DataFrame:
    return signals.group_cohesion(t("embeddings"), "label", "vec_id", "embedding", 1.5).withColumn("cohesion", r6("cohesion"))


@query(f"SELECT vec_id FROM ({_OUT}) WHERE outlier")
def r18_anomaly_sweep(t: Tables) -> DataFrame:
    return signals.group_cohesion(t("embeddings"), "label", "vec_id", "embedding", 1.5).where("outlier").select("vec_id")


@query(f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY cohesion, vec_id) AS r FROM ({_OUT})) WHERE r = 1")
def g22_odd_one_out(t: Tables) -> DataFrame:
    c = signals.group_cohesion(t("embeddings"), "label", "vec_id", "embedding", 1.5)
    return c.groupBy("label").agg(F.min_by("vec_id", F.struct(r6("cohesion"), "vec_id")).alias("vec_id"))


_TRADE = "l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), e AS (SELECT DISTINCT a.s AS src, b.s AS dst FROM l a JOIN l b ON a.o = b.o AND a.s <> b.s)"


def _trade(t: Tables) -> DataFrame:
    """Suppliers and those that they share an order with: src, dsts."""
    return mining.adjacency(mining.sharing(t("lineitem"), "l_orderkey", "l_suppkey"))


def _central(rounds: int) -> str:
    steps = [f"WITH {_TRADE}, x0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS x FROM e)"]
    for i in range(rounds):
        steps.append(f"y{i} AS (SELECT x{i}.id, x{i}.x + coalesce(c.s, 0) AS x FROM x{i} LEFT JOIN (SELECT dst AS id, sum(x) AS s FROM e JOIN x{i} ON e.src = x{i}.id GROUP BY 1) c USING (id)), x{i + 1} AS (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM y{i})")
    return ", ".join(steps)


ORACLES["g01_centrality"] = f"{_central(6)} SELECT id, round(x, 6) AS centrality FROM x6"


@query(f"{_central(6)} SELECT id, round(x, 6) AS centrality FROM x6 ORDER BY centrality DESC, id LIMIT 10")
def t13_keystones(t: Tables) -> DataFrame:
    return mining.eigenvector(_trade(t), 6).select("id", r6("x").alias("centrality")).orderBy(F.desc("centrality"), "id").limit(10)


QUERIES["q20_keystones"], ORACLES["q20_keystones"] = QUERIES["t13_keystones"], ORACLES["t13_keystones"]


def _walk(seeds: str, rounds: int) -> str:
    steps = [f"WITH {_TRADE}, g AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1), s AS ({seeds}), o AS (SELECT id, 1.0 / (SELECT count(*) FROM s) AS own FROM s), x0 AS (SELECT id, own AS m FROM o)"]
    for i in range(rounds):
        steps.append(f"c{i} AS (SELECT e.dst AS id, sum(0.85 * m / deg) AS m FROM e JOIN x{i} ON e.src = x{i}.id JOIN g ON g.id = e.src GROUP BY 1), x{i + 1} AS (SELECT coalesce(c{i}.id, o.id) AS id, coalesce(c{i}.m, 0) + coalesce(o.own * (1 - (SELECT sum(m) FROM c{i})), 0) AS m FROM c{i} FULL JOIN o ON o.id = c{i}.id)")
    return ", ".join(steps)


_SEEDS = "SELECT DISTINCT src AS id FROM e ORDER BY id LIMIT 3"


def _walked(t: Tables, n: int) -> DataFrame:
    e = _trade(t)
    return signals.restart_walk(e, e.select(F.col("src").alias("id")).orderBy("id").limit(n), 5)


@query(f"{_walk(_SEEDS, 5)} SELECT id, round(m, 6) AS mass FROM x5")
def g02_restart_walk(t: Tables) -> DataFrame:
    return _walked(t, 3).select("id", r6("mass").alias("mass"))


@query(f"{_walk('SELECT min(src) AS id FROM e', 5)} SELECT id, round(m, 6) AS mass FROM x5 WHERE id NOT IN (SELECT id FROM s) ORDER BY mass DESC, id LIMIT 10")
def g04_spreading_activation(t: Tables) -> DataFrame:
    e = _trade(t)
    seed = e.agg(F.min("src").alias("id"))
    return signals.restart_walk(e, seed, 5).join(seed, "id", "left_anti").select("id", r6("mass").alias("mass")).orderBy(F.desc("mass"), "id").limit(10)


QUERIES["q18_free_association"], ORACLES["q18_free_association"] = QUERIES["g04_spreading_activation"], ORACLES["g04_spreading_activation"]


@query(f"{_walk(_SEEDS, 5)} SELECT id, round(m, 6) AS mass, CASE WHEN id IN (SELECT id FROM s) THEN 'both' ELSE 'walk' END AS provenance FROM x5 ORDER BY mass DESC, id LIMIT 15")
def q09_connected_recall(t: Tables) -> DataFrame:
    e = _trade(t)
    seeds = e.select(F.col("src").alias("id")).orderBy("id").limit(3)
    walked = signals.restart_walk(e, seeds, 5).join(F.broadcast(seeds.withColumn("anchor", F.lit(True))), "id", "left")
    return walked.select("id", r6("mass").alias("mass"), F.when(F.col("anchor"), "both").otherwise("walk").alias("provenance")).orderBy(F.desc("mass"), "id").limit(15)


QUERIES["g03_visit_counts"] = lambda spark, sf_dir: QUERIES["g02_restart_walk"](spark, sf_dir).select("id", F.round(F.col("mass") * 4000).cast("long").alias("visits"))
ORACLES["g03_visit_counts"] = f"SELECT id, CAST(round(mass * 4000) AS BIGINT) AS visits FROM ({ORACLES['g02_restart_walk']})"

_WILSON = "(p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)"


@query(f"{R}, g AS (SELECT operational & 63 AS action, (operational >> 6) & 63 AS outcome, count(*) AS n, avg(CAST((provenance >> 18) & 63 >= 1 AS INT)) AS p FROM r GROUP BY 1, 2) SELECT action, outcome, n, round({_WILSON}, 6) AS lower FROM g ORDER BY lower DESC, n DESC, action, outcome LIMIT 20")
def q25_anticipate(t: Tables) -> DataFrame:
    r = schema.records(t("documents")).select(schema.CAPTURE.value().alias("action"), schema.KIND.value().alias("outcome"), (schema.CONFIRMATION.value() >= 1).alias("ok"))
    g = statistics.outcomes(r, "action", "outcome", F.col("ok")).select("action", "outcome", F.col("trials").alias("n"), r6("lower").alias("lower"))
    return g.orderBy(F.desc("lower"), F.desc("n"), "action", "outcome").limit(20)


QUERIES["t11_best_actions"], ORACLES["t11_best_actions"] = QUERIES["q25_anticipate"], ORACLES["q25_anticipate"]


@query(R + " SELECT doc_id, provenance & 63 AS authority, round(((provenance >> 24) & 63) / 56.0, 6) AS confidence FROM r ORDER BY authority DESC, confidence DESC, doc_id LIMIT 50")
def q17_trust_lens(t: Tables) -> DataFrame:
    r = schema.records(t("documents")).select("doc_id", schema.SOURCE_TYPE.value().alias("authority"), r6(schema.CONFIDENCE.value() / 56.0).alias("confidence"))
    return r.orderBy(F.desc("authority"), F.desc("confidence"), "doc_id").limit(50)


@query("SELECT o_orderpriority AS plan, round(avg(o_totalprice) / 1000, 6) AS gain FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'Z') = 0 ORDER BY gain DESC, plan")
def t19_plan_ranking(t: Tables) -> DataFrame:
    g = t("orders").groupBy(F.col("o_orderpriority").alias("plan")).agg(r6(F.avg("o_totalprice") / 1000).alias("gain"), F.count_if(F.col("o_orderstatus") == "Z").alias("lost"))
    return g.where("lost = 0").select("plan", "gain").orderBy(F.desc("gain"), "plan")


@query("SELECT l_orderkey, max(l_linenumber) AS tier, bool_or(l_returnflag = 'R') AS contested, count(DISTINCT l_suppkey) + CASE WHEN count(DISTINCT l_suppkey % 3) >= 2 THEN 1 ELSE 0 END AS weight, max(l_shipdate) AS recent FROM lineitem GROUP BY 1 ORDER BY tier, contested DESC, weight DESC, recent DESC, l_orderkey LIMIT 40")
def t20_review_queue(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("tier"), F.bool_or(F.col("l_returnflag") == "R").alias("contested"), F.collect_set("l_suppkey").alias("by"), F.max("l_shipdate").alias("recent"))
    families = F.size(F.array_distinct(F.transform("by", lambda x: x % 3)))
    out = g.select("l_orderkey", "tier", "contested", (F.size("by") + F.when(families >= 2, 1).otherwise(0)).cast("long").alias("weight"), "recent")
    return out.orderBy("tier", F.desc("contested"), F.desc("weight"), F.desc("recent"), "l_orderkey").limit(40)


@query(_FP_SQL + " SELECT doc_id, CAST((row_number() OVER (ORDER BY b0, doc_id) - 1) // 250 AS BIGINT) AS chest FROM f")
def t18_chest_deal(t: Tables) -> DataFrame:
    return signals.dealt_in_order(fingerprints(t("documents")).select("doc_id", "b0"), [F.col("b0"), F.col("doc_id")], 250).select("doc_id", "chest")


@query(f"WITH d AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), f AS (SELECT term, count(*) / (SELECT count(*) FROM documents) AS df FROM d GROUP BY 1) SELECT round(sum(df) FILTER (df >= 2.0 / (SELECT count(*) FROM documents)), 4) AS signal, round(sum(df) FILTER (df < 2.0 / (SELECT count(*) FROM documents)), 4) AS noise FROM f")
def a47_signal_to_noise(t: Tables) -> DataFrame:
    d = t("documents")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    df = d.select(F.explode(F.array_distinct(sc.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n)).select((F.col("c") / F.col("n")).alias("df"), (2.0 / F.col("n")).alias("limit"))
    side = lambda ok: F.round(F.sum(F.when(ok, F.col("df"))), 4)
    return df.agg(side(F.col("df") >= F.col("limit")).alias("signal"), side(F.col("df") < F.col("limit")).alias("noise"))


_OR = {lang: f"(SELECT {', '.join(f'bit_or({b}) AS {b}' for b in _B)} FROM f WHERE lang = '{lang}' AND doc_id % 97 = 1)" for lang in ("en", "fr")}


@query(_FP_SQL + f" SELECT round(1 - (CAST(bit_count(xor(a.b0, c.b0)) AS BIGINT) + bit_count(xor(a.b1, c.b1)) + bit_count(xor(a.b3, c.b3))) / 192.0, 6) AS overlap FROM {_OR['en']} a, {_OR['fr']} c")
def g25_mind_overlap(t: Tables) -> DataFrame:
    f = fingerprints(t("documents")).where("doc_id % 97 = 1")
    side = lambda lang, p: f.where(F.col("lang") == lang).agg(*(F.bit_or(b).alias(f"{p}{b}") for b in _B))
    at = ["b0", "b1", "b3"]
    return side("en", "x").join(F.broadcast(side("fr", "y"))).select(r6(1 - sc.hamming([f"x{b}" for b in at], [f"y{b}" for b in at]) / 192.0).alias("overlap"))


QUERIES["q30_mind_overlap"], ORACLES["q30_mind_overlap"] = QUERIES["g25_mind_overlap"], ORACLES["g25_mind_overlap"]


@query("WITH w AS (SELECT CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS day, bit_or(event_id * 2654435761 % 4294967296) AS s, count(*) AS n FROM events GROUP BY 1), p AS (SELECT s AS q FROM w ORDER BY day LIMIT 1) SELECT day, n, CAST(bit_count(xor(s, q)) AS INTEGER) AS distance FROM w, p ORDER BY distance, day LIMIT 10")
def q26_moment(t: Tables) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    w = t("events").groupBy(day.alias("day")).agg(F.bit_or(F.col("event_id") * 2654435761 % 4294967296).alias("s"), F.count(F.lit(1)).alias("n"))
    probe = w.agg(F.min_by("s", "day").alias("q"))
    return w.join(F.broadcast(probe)).select("day", "n", F.bit_count(F.col("s").bitwiseXOR(F.col("q"))).alias("distance")).orderBy("distance", "day").limit(10)


@query("WITH c AS (SELECT lang AS room, sum(exp(-ln(2) * doc_id / 500.0)) AS w, count(*) AS n, count(*) FILTER (source = 'src1') AS dismissed FROM documents GROUP BY 1) SELECT room, round(w / sum(w) OVER () - n / sum(n) OVER (), 6) AS momentum, round(dismissed / n, 6) AS dismissal, round(dismissed / sum(dismissed) OVER () - (n - dismissed) / sum(n - dismissed) OVER (), 6) AS bias FROM c")
def q23_bias(t: Tables) -> DataFrame:
    c = t("documents").groupBy(F.col("lang").alias("room")).agg(F.sum(F.exp(-F.lit(0.6931471805599453) * F.col("doc_id") / 500.0)).alias("w"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "src1").alias("d"))
    total = c.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"), F.sum("d").alias("td"))
    return c.join(F.broadcast(total)).select("room", r6(F.col("w") / F.col("tw") - F.col("n") / F.col("tn")).alias("momentum"), r6(F.col("d") / F.col("n")).alias("dismissal"), r6(F.try_divide("d", "td") - F.try_divide(F.col("n") - F.col("d"), F.col("tn") - F.col("td"))).alias("bias"))


QUERIES["q21_theme_weather"] = lambda spark, sf_dir: QUERIES["q23_bias"](spark, sf_dir).select("room", "momentum")
ORACLES["q21_theme_weather"] = f"SELECT room, momentum FROM ({ORACLES['q23_bias']})"
for _new, _old in {"q27_rhythm": "d30_dominant_period", "q28_precedence": "t12_precedence", "q29_complexity": "a29_mutual_information", "q19_constellation": "g05_communities"}.items():
    QUERIES[_new], ORACLES[_new] = QUERIES[_old], ORACLES[_old]


# --- standing jobs, merges and feeds


@query(f"SELECT DISTINCT least(e.vec_id, p.vec_id) AS a, greatest(e.vec_id, p.vec_id) AS b FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 20) p WHERE e.vec_id <> p.vec_id AND round(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE), 2))), 6) <= 1.5")
def r17_similarity_signal(t: Tables) -> DataFrame:
    e = t("embeddings").select(F.col("vec_id").alias("item"), "embedding")
    probes = e.orderBy(F.desc("item")).limit(20).toDF("probe", "q")
    d = F.round(F.aggregate(F.zip_with("embedding", "q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x), 6)
    return signals.near_probes(e, probes, d, 1.5)


QUERIES["z20_associate_sweep"], ORACLES["z20_associate_sweep"] = QUERIES["r17_similarity_signal"], ORACLES["r17_similarity_signal"]


@query(R + ", n AS (SELECT max(filed_at) AS now FROM r), x AS (SELECT doc_id, (epoch_us(now) - epoch_us(filed_at)) / 1000000.0 AS age, doc_id % 3 = 0 AS gone FROM r, n) SELECT 'decay' AS category, doc_id FROM x WHERE NOT gone AND age > 864000 AND doc_id % 10 <> 0 UNION ALL SELECT 'tombstone', doc_id FROM x WHERE gone AND age > 1728000 AND doc_id % 10 <> 0")
def r15_maintenance(t: Tables) -> DataFrame:
    """Active rows older than their window and tombstoned ones past their grace (both strictly), less what was proposed before."""
    r = schema.records(t("documents"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("filed_at").cast("timestamp"))) / 1000000
    x = r.join(F.broadcast(r.agg(F.max("filed_at").alias("now")))).select("doc_id", age.alias("age"), (F.col("doc_id") % 3 == 0).alias("gone"))
    due = F.when(~F.col("gone") & (F.col("age") > 864000), "decay").when(F.col("gone") & (F.col("age") > 1728000), "tombstone")
    proposed = r.where("doc_id % 10 = 0").select("doc_id")
    return x.select(due.alias("category"), "doc_id").where("category is not null").join(proposed, "doc_id", "left_anti").select("category", "doc_id")


@query("SELECT user_id, arg_max(event_id, (event_id % 2 = 0, event_id)) AS event_id FROM events GROUP BY 1")
def r24_local_wins(t: Tables) -> DataFrame:
    """A fixed side wins: local rows (even ids) before remote ones, the newest of a side."""
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct((F.col("event_id") % 2 == 0), "event_id")).alias("event_id"))


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def r26_origin_filter(t: Tables) -> DataFrame:
    origin = F.when(F.col("event_id") % 5 == 0, "sync").otherwise("local")
    return t("events").withColumn("origin", origin).where("origin = 'local'").select("event_id")


@query("SELECT doc_id, CAST(doc_id AS BIGINT) AS revision, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 200")
def s26_change_feed(t: Tables) -> DataFrame:
    """A batch of changes after a cursor, with digests and without texts."""
    d = t("documents").where("doc_id > 100").orderBy("doc_id").limit(200)
    return d.select("doc_id", F.col("doc_id").cast("long").alias("revision"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(R + " SELECT 'drawer-' || doc_id AS id, wing, room, 'note' AS kind, n_chars FROM r WHERE operational & 2097152 = 0")
def s23_pump_mapping(t: Tables) -> DataFrame:
    r = schema.records(t("documents")).where(F.col("operational").bitwiseAND(F.lit(schema.ABSORBED)) == 0)
    return r.select(F.concat(F.lit("drawer-"), F.col("doc_id").cast("string")).alias("id"), "wing", "room", F.lit("note").alias("kind"), "n_chars")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r02_drained_stream(t: Tables) -> DataFrame:
    """A real stream over the events' file, drained once into Parquet by micro-batches that its checkpoint commits."""
    from lodestone.streaming.twins import drained_file, windowed

    return drained_file(t("events"), windowed)
