"""Matrix, graph and fingerprint lanes, pruning by containers, daily tournaments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import schema
from lodestone.operators import bits, mining, preference, search
from lodestone.plans import fields, signals  # noqa: F401  their queries are reused below
from lodestone.plans.registry import ORACLES, QUERIES, Tables, query, r6

R = "WITH " + schema.RECORDS_SQL
#: Bits of the packed adjective column that are set anywhere.
BITS = 25
#: The row, the supplier and the event type that ask.
ASKING_ROW, ASKING_SUPPLIER, ASKING_TYPE = 0, 1, "click"
#: Parameters of the private union: budget, least number of contributors, seed.
EPSILON, CONTRIBUTORS, SEED = 1.0, 20, 7


@query(f"{R}, n AS (SELECT unnest({bits.laplace(SEED, BITS, 1 / EPSILON)}) AS noise, unnest(range(0, {BITS})) AS bit), c AS (SELECT bit, count(*) FILTER ((adjective >> bit) & 1 = 1) AS n FROM r, (SELECT unnest(range(0, {BITS})) AS bit) GROUP BY 1) SELECT CAST(bit AS INTEGER) AS bit, c.n + noise >= {CONTRIBUTORS} AS held FROM c JOIN n USING (bit)")
def a12_private_or(t: Tables) -> DataFrame:
    return bits.private_or(schema.records(t("documents")), "adjective", BITS, EPSILON, CONTRIBUTORS, SEED)


_SET = f"{R}, s AS (SELECT doc_id, bit FROM r, (SELECT unnest(range(0, {BITS})) AS bit) WHERE (adjective >> bit) & 1 = 1), q AS (SELECT bit FROM s WHERE doc_id = {ASKING_ROW})"


@query(_SET + ", c AS (SELECT a.bit AS asked, b.bit, count(*) / (SELECT count(*) FROM r) AS c FROM s a JOIN s b USING (doc_id) WHERE a.bit IN (SELECT bit FROM q) GROUP BY 1, 2) SELECT r.doc_id, round(coalesce(sum(c.c), 0), 6) AS fit FROM r LEFT JOIN s ON r.doc_id = s.doc_id LEFT JOIN c ON s.bit = c.bit GROUP BY 1")
def d34_field_fit(t: Tables) -> DataFrame:
    """The sum of C over the set bits of a row and those of the asking row; C has BITS cells a side at most."""
    r = schema.records(t("documents")).select("doc_id", "adjective")
    asked = r.where(F.col("doc_id") == ASKING_ROW).limit(1).select(bits.set_bits(F.col("adjective"), BITS).alias("asked"))
    # rows of equal packed values count together, so what is exploded is bounded by the values
    values = r.groupBy("adjective").agg(F.count(F.lit(1)).alias("n")).withColumn("bits", bits.set_bits(F.col("adjective"), BITS))
    pairs = values.join(F.broadcast(asked)).select("n", "bits", F.explode(F.array_intersect("bits", "asked")).alias("a")).select("n", F.explode("bits").alias("bit"))
    cells = pairs.groupBy("bit").agg(F.sum("n").alias("c")).join(F.broadcast(r.agg(F.count(F.lit(1)).alias("all")))).select("bit", (F.col("c") / F.col("all")).alias("c"))
    fits = values.select("adjective", F.explode("bits").alias("bit")).join(F.broadcast(cells), "bit").groupBy("adjective").agg(F.sum("c").alias("fit"))
    return r.join(fits, "adjective", "left").select("doc_id", F.round(F.coalesce("fit", F.lit(0.0)), 6).alias("fit"))


@query(f"WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT b.l_suppkey AS candidate, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM s), 9) AS score FROM s a JOIN s b USING (l_orderkey) WHERE a.l_suppkey = {ASKING_SUPPLIER} AND b.l_suppkey <> {ASKING_SUPPLIER} GROUP BY 1")
def d35_cooccurrence_score(t: Tables) -> DataFrame:
    """O[asked, candidate] / N: only rows that hold the asked item are formed into pairs."""
    s = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
    with_asked = s.where(F.col("l_suppkey") == ASKING_SUPPLIER).select("l_orderkey")
    total = s.select("l_orderkey").distinct().agg(F.count(F.lit(1)).alias("all"))
    found = s.where(F.col("l_suppkey") != ASKING_SUPPLIER).join(with_asked, "l_orderkey", "left_semi").groupBy(F.col("l_suppkey").alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(total)).select("candidate", F.round(F.col("n") / F.col("all"), 9).alias("score"))


@query(f"WITH m AS ({ORACLES['a06_temporal_matrix']}) SELECT target, lag, round(n / (SELECT sum(n) FROM m), 9) AS score FROM m WHERE source = '{ASKING_TYPE}'")
def d36_temporal_score(t: Tables) -> DataFrame:
    m = signals.a06_temporal_matrix(t)
    shares = m.withColumn("all", F.sum("n").over(Window.partitionBy()))  # over the cells of one matrix: types squared times eight lags
    return shares.where(F.col("source") == ASKING_TYPE).select("target", "lag", F.round(F.col("n") / F.col("all"), 9).alias("score"))


@query(f"WITH f AS ({ORACLES['d15_float_simhash']}) SELECT p.vec_id AS probe, f.vec_id, CAST(bit_count(xor(f.signs, p.signs)) AS INTEGER) AS distance FROM f JOIN f p ON p.vec_id % 100 = 0 AND f.vec_id <> p.vec_id AND bit_count(xor(f.signs, p.signs)) <= 3")
def z08_multi_index(t: Tables) -> DataFrame:
    f = fields.d15_float_simhash(t)
    return search.within_bits(f, f.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "probe"), "vec_id", "signs", 16, 3).where("probe <> vec_id")


@query("WITH e AS (SELECT DISTINCT l_suppkey AS seed, l_partkey AS item FROM lineitem), n AS (SELECT item, count(*) AS seeds FROM e WHERE seed <= 5 GROUP BY 1) SELECT item, seeds, row_number() OVER (ORDER BY seeds DESC, item) AS rank FROM n ORDER BY rank LIMIT 40")
def z19_graph_lane(t: Tables) -> DataFrame:
    """Neighbours of the seeds, those of more seeds first."""
    e = t("lineitem").where("l_suppkey <= 5").select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("item")).distinct()
    near = e.groupBy("item").agg(F.count(F.lit(1)).alias("seeds"))
    return search.ranked(search.top(near, "seeds", 40, "item"), "seeds", "item").select("item", "seeds", F.col("rank").cast("long").alias("rank"))


@query(f"{R} SELECT doc_id, wing, room FROM r WHERE operational & {schema.VAGUE | schema.ABSORBED} = {schema.VAGUE | schema.ABSORBED}")
def z24_container_pruning(t: Tables) -> DataFrame:
    """A container whose OR of masks lacks an asked bit has no such row; only rows of the others are looked at."""
    r, mask = schema.records(t("documents")), F.lit(schema.VAGUE | schema.ABSORBED)
    holds = r.groupBy("wing", "room").agg(F.bit_or("operational").alias("any")).where(F.col("any").bitwiseAND(mask) == mask)
    alive = r.join(holds.select("wing", "room"), (r["wing"].eqNullSafe(holds["wing"])) & (r["room"].eqNullSafe(holds["room"])), "left_semi")
    return alive.where(F.col("operational").bitwiseAND(mask) == mask).select("doc_id", "wing", "room")


_ROWS = "i AS (SELECT row_number() OVER () AS row, * FROM lineitem), x AS (SELECT row, unnest(['flag=' || l_returnflag, 'status=' || l_linestatus, 'line=' || l_linenumber]) AS item FROM i)"


@query(f"WITH {_ROWS}, p AS (SELECT a.item AS a, b.item AS b, row FROM x a JOIN x b USING (row) WHERE a.item < b.item), e AS (SELECT a, b, count(*) AS extent FROM p GROUP BY 1, 2), n AS (SELECT a, b, item, count(*) AS n FROM p JOIN x USING (row) GROUP BY 1, 2, 3) SELECT a, b, extent, string_agg(item, ';' ORDER BY item) AS intent FROM n JOIN e USING (a, b) WHERE n = extent GROUP BY 1, 2, 3")
def z11_multi_seed_concepts(t: Tables) -> DataFrame:
    """The concept that each pair of attributes generates: its extent's size and closed intent."""
    cells = F.array(*(F.concat(F.lit(k + "="), F.col(c)) for k, c in (("flag", "l_returnflag"), ("status", "l_linestatus"), ("line", "l_linenumber"))))
    return mining.pair_concepts(t("lineitem").select(cells.alias("items")))


@query("WITH s AS (SELECT * FROM (SELECT l_partkey AS subject, l_orderkey AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE k <= 50) SELECT a.id AS a, b.id AS b FROM s a JOIN s b USING (subject) WHERE a.id < b.id UNION SELECT DISTINCT least(l_orderkey, l_suppkey), greatest(l_orderkey, l_suppkey) FROM lineitem WHERE l_orderkey <> l_suppkey")
def g21_centrality_edges(t: Tables) -> DataFrame:
    """Direct edges, and those between rows of one subject; a subject ties its first 50 rows, by definition."""
    return mining.subject_edges(t("lineitem"), "l_orderkey", "l_partkey", "l_suppkey")


_BEATEN = "WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type AS kind, sum(CAST(round(value * 10000) AS BIGINT)) AS total FROM events GROUP BY 1, 2, 3), p AS (SELECT day, user_id, arg_max(kind, (total, kind)) AS winner FROM d GROUP BY 1, 2)"


@query(f"{_BEATEN} SELECT p.day, p.winner, d.kind AS loser, count(*) AS n FROM p JOIN d USING (day, user_id) WHERE d.kind <> p.winner GROUP BY 1, 2, 3")
def r22_daily_tournament(t: Tables) -> DataFrame:
    return preference.daily_outcomes(t("events"), "ts", "user_id", "event_type", F.round(F.col("value") * 10000).cast("long")).withColumn("day", F.col("day").cast("string"))


@query()
def a23_strengths(t: Tables) -> DataFrame:
    counts = r22_daily_tournament(t).groupBy("winner", "loser").agg(F.sum("n").alias("n"))
    return preference.strengths(counts).select("item", r6("strength").alias("strength"), r6("low").alias("low"), r6("high").alias("high"))


QUERIES["a37_learned_preference"] = QUERIES["a23_strengths"]
