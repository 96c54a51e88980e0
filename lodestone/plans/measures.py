"""More queries by operator id: digests, scores, rhythms and set comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import schema
from lodestone.functions import digests as dg
from lodestone.functions import scalars as sc
from lodestone.functions import textrules as tr
from lodestone.operators import scoring, statistics
from lodestone.plans.registry import Tables, query, r6

R = "WITH " + schema.RECORDS_SQL

# --- sources and change feeds


@query("SELECT event_id, event_type FROM events WHERE json_valid(props)")
def s03_clean_rows(t: Tables) -> DataFrame:
    return t("events").where(tr.valid_json(F.col("props"))).select("event_id", "event_type")


@query("SELECT count(*) FILTER (json_valid(text)) AS clean, count(*) FILTER (NOT coalesce(json_valid(text), false)) AS skipped FROM documents")
def s03_skipped_count(t: Tables) -> DataFrame:
    ok = F.coalesce(tr.valid_json(F.col("text")), F.lit(False))
    return t("documents").agg(F.count_if(ok).alias("clean"), F.count_if(~ok).alias("skipped"))


@query(R + " SELECT doc_id, wing, room FROM r WHERE (adjective & 63) >> 4 = 0 AND (adjective >> 12) & 63 = 32 AND (adjective >> 6) & 63 <= 16")
def s22_export_scope(t: Tables) -> DataFrame:
    believed = F.shiftright(schema.STATE.value(), 4) == 0
    return schema.records(t("documents")).where(believed & (schema.EXPORTABILITY.value() == 32) & (schema.SENSITIVITY.value() <= 16)).select("doc_id", "wing", "room")


@query("SELECT doc_id FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def u06_kept_partition(t: Tables) -> DataFrame:
    return t("documents").where(F.regexp_like("text", F.lit(r"[^ \t\n\r]"))).select("doc_id")


# --- aggregations


@query(R + " SELECT CAST(i AS INTEGER) AS bit, round(sum((adjective >> i) & 1) / count(*), 6) AS share FROM r, range(24) x(i) GROUP BY i")
def a04_marginals(t: Tables) -> DataFrame:
    bits = F.array(*(F.shiftright("adjective", i).bitwiseAND(F.lit(1)) for i in range(24)))
    return schema.records(t("documents")).select(F.posexplode(bits).alias("bit", "x")).groupBy("bit").agg(r6(F.avg("x")).alias("share"))


_SECONDS = "floor(epoch_us(ts) / 1000000.0 / {n})"


@query(" UNION ALL ".join(f"SELECT '{k}' AS level, CAST({_SECONDS.format(n=n)} AS BIGINT) AS bucket, bit_or(event_id) AS mask, count(*) AS n FROM events GROUP BY 2" for k, n in scoring.LEVELS.items()))
def a15_cascade(t: Tables) -> DataFrame:
    return scoring.cascade(t("events"), "ts", "event_id")


@query("SELECT event_type, bit_or(event_id) AS mask, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def a16_moment(t: Tables) -> DataFrame:
    inside = F.col("ts").between(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return t("events").where(inside).groupBy("event_type").agg(F.bit_or("event_id").alias("mask"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def a21_entries_since(t: Tables) -> DataFrame:
    return t("events").where(F.col("ts") > F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "user_id")


@query("SELECT o_orderpriority AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def a34_distribution(t: Tables) -> DataFrame:
    counted = t("orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def a35_column_entropy(t: Tables) -> DataFrame:
    long = t("lineitem").withColumn("row", F.lit(0))
    counted = scoring.attributes(long, "row", ["l_returnflag", "l_linestatus", "l_linenumber"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    share = counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("field")))
    return share.groupBy(F.col("field").alias("column_name")).agg(r6(F.sum(sc.binary_entropy_term(F.col("p")))).alias("entropy"))


@query("WITH c AS (SELECT o_orderpriority AS label, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1) SELECT label, round(a / sum(a) OVER () - b / sum(b) OVER (), 6) AS difference FROM c")
def a36_bias(t: Tables) -> DataFrame:
    out = scoring.share_difference(t("orders"), "o_orderpriority", F.col("o_orderstatus") == "F")
    return out.select(F.col("o_orderpriority").alias("label"), r6("difference").alias("difference"))


@query("SELECT l_linestatus AS room, count(*) FILTER (l_returnflag = 'R') AS dismissed, count(*) AS total, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem GROUP BY 1")
def a38_dismissal_rate(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy(F.col("l_linestatus").alias("room")).agg(F.count_if(F.col("l_returnflag") == "R").alias("dismissed"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("rate", r6(F.col("dismissed") / F.col("total")))


@query("SELECT event_id, round(CASE WHEN a <= 0 THEN 1 ELSE exp(-ln(2) * a / 86400) END, 6) AS weight FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000.0 AS a FROM events)")
def a40_recency(t: Tables) -> DataFrame:
    e = t("events")
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000000
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", r6(sc.decay(age, 86400.0)).alias("weight"))


@query("SELECT l_partkey AS target, count(*) FILTER (l_returnflag = 'N') AS used, count(*) FILTER (l_returnflag <> 'N') AS unused, CAST(max(CAST(l_returnflag = 'N' AS INT)) AS INTEGER) AS reward FROM lineitem GROUP BY 1")
def a42_outcomes(t: Tables) -> DataFrame:
    used = F.col("l_returnflag") == "N"
    return t("lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.count_if(used).alias("used"), F.count_if(~used).alias("unused"), F.max(used.cast("int")).alias("reward"))


_TOP = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {by}, o_orderkey) AS r FROM orders"


@query(f"""WITH e AS (SELECT o_custkey, list(o_orderkey) AS e FROM ({_TOP.format(by='o_totalprice DESC')}) WHERE r <= 5 GROUP BY 1), f AS (SELECT o_custkey, list(o_orderkey ORDER BY r) AS f FROM ({_TOP.format(by='o_orderdate DESC')}) WHERE r <= 5 GROUP BY 1)
SELECT o_custkey, round(len(list_intersect(e, f)) / len(list_distinct(list_concat(e, f))), 6) AS overlap, round(len(list_intersect(e, f)) / len(f), 6) AS precision, round(coalesce(1 / list_min(list_filter(range(1, len(f) + 1), lambda i: list_contains(e, f[i]))), 0), 6) AS mrr FROM e JOIN f USING (o_custkey)""")
def a43_recall_scores(t: Tables) -> DataFrame:
    o = t("orders")

    def five(by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(by), "o_orderkey"))
        top = o.select("o_custkey", "o_orderkey", rank.alias("r")).where("r <= 5").groupBy("o_custkey")
        return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))), lambda x: x["o_orderkey"]).alias(by))

    both = five("o_totalprice").join(five("o_orderdate"), "o_custkey")
    return both.select("o_custkey", *(r6(c).alias(k) for k, c in scoring.recall_scores(F.col("o_totalprice"), F.col("o_orderdate")).items()))


@query("SELECT user_id, round(sum(exp(-0.1 * (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0)), 6) AS volatility FROM (SELECT DISTINCT user_id, ts FROM events) GROUP BY 1")
def a45_volatility(t: Tables) -> DataFrame:
    return scoring.volatility(t("events"), "user_id", "ts", 0.1).withColumn("volatility", r6("volatility"))


_TERMS = r"w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(replace(lower(text), 'ς', 'σ'), '[^\p{L}0-9]+'), lambda x: x <> ''))) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM w GROUP BY 1)"


def _df(t: Tables) -> DataFrame:
    return t("documents").select(F.explode(F.array_distinct(sc.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {_TERMS} SELECT term, df FROM d WHERE df >= 2 ORDER BY df DESC, term LIMIT 512")
def a50_vocabulary(t: Tables) -> DataFrame:
    return _df(t).where("df >= 2").orderBy(F.desc("df"), "term").limit(512)


@query(f"WITH {_TERMS}, n AS (SELECT count(*) AS n FROM documents) SELECT term, round(df * (1 - CASE WHEN df = n THEN 0 ELSE -(df / n) * log2(df / n) - (1 - df / n) * log2(1 - df / n) END), 6) AS score FROM d, n")
def a48_structural_score(t: Tables) -> DataFrame:
    n = t("documents").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("df") / F.col("n")
    return _df(t).crossJoin(F.broadcast(n)).select("term", r6(F.col("df") * (1 - sc.binary_entropy_term(p) - sc.binary_entropy_term(1 - p))).alias("score"))


@query("SELECT source AS wing, lang AS room, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def a52_bundles(t: Tables) -> DataFrame:
    return t("documents").rollup(F.col("source").alias("wing"), F.col("lang").alias("room")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS peak FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)")
def a53_telemetry(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id").rowsBetween(-15, 0)
    return t("events").select("event_id", r6(F.avg("value").over(w)).alias("mean"), F.max("value").over(w).alias("peak"))


# --- windows, ranks and rhythms


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1".replace("quantile_cont(value, ", "round(quantile_cont(value, ").replace(") AS p", "), 6) AS p"))
def w14_percentiles(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(*(r6(F.percentile("value", q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)))


@query("SELECT event_id, CASE WHEN s < 1e-6 THEN false ELSE abs((value - m) / s) >= 3 END AS flagged FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s FROM events)")
def w05_flags(t: Tables) -> DataFrame:
    return statistics.z_scores(t("events"), ["event_type"], "value").select("event_id", F.coalesce(F.abs("z") >= 3, F.lit(False)).alias("flagged"))


@query(R + " SELECT room, CAST(floor(epoch_us(filed_at) / 1000000.0 / 86400) AS BIGINT) AS bucket, CAST(max((operational >> 20) & 1) AS BIGINT) AS present FROM r GROUP BY ALL")
def w12_bit_series(t: Tables) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("filed_at").cast("timestamp")) / 86400000000)
    return schema.records(t("documents")).groupBy("room", day.alias("bucket")).agg(F.max(F.shiftright("operational", 20).bitwiseAND(F.lit(1))).alias("present"))


_WAVE = "WITH b AS (SELECT CAST(floor(epoch_us(ts) / 1000000.0 / 3600) AS BIGINT) AS b, count(*) AS v FROM events GROUP BY 1), s AS (SELECT b - (SELECT max(b) FROM b) + 255 AS i, v FROM b), w AS (SELECT k AS bin, sum(v * cos(2 * pi() / 256 * i * k)) AS re, sum(v * sin(2 * pi() / 256 * i * k)) AS im FROM s, range(1, 129) x(k) WHERE i >= 0 GROUP BY 1)"


@query(_WAVE + " SELECT CAST(bin AS INTEGER) AS bin, round(re * re + im * im, 3) AS power, round(256.0 / bin, 6) AS period FROM w")
def d29_spectrum(t: Tables) -> DataFrame:
    return scoring.spectrum(t("events"), "ts", "hour", 256).select("bin", F.round("power", 3).alias("power"), r6("period").alias("period"))


@query(_WAVE + " SELECT CAST(bin AS INTEGER) AS bin, round(256.0 / bin, 6) AS period FROM w ORDER BY round(re * re + im * im, 3) DESC, bin LIMIT 1")
def d30_dominant_period(t: Tables) -> DataFrame:
    return scoring.spectrum(t("events"), "ts", "hour", 256).orderBy(F.round("power", 3).desc(), "bin").limit(1).select("bin", r6("period").alias("period"))


_NEXT = "SELECT anchor, target, n, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, target) AS rank FROM (SELECT event_type AS anchor, target, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY ALL)"


@query(_NEXT)
def g24_successors(t: Tables) -> DataFrame:
    return scoring.successors(t("events"), "user_id", ["ts", "event_id"], "event_type").withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT target, anchor, n FROM ({_NEXT}) WHERE target = 'purchase' ORDER BY n DESC, anchor LIMIT 3")
def t12_precedence(t: Tables) -> DataFrame:
    return scoring.successors(t("events"), "user_id", ["ts", "event_id"], "event_type").where("target = 'purchase'").orderBy(F.desc("n"), "anchor").limit(3).select("target", "anchor", "n")


@query("SELECT user_id, event_id, ts, lead(ts) OVER w AS superseded_at, CASE WHEN lead(ts) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS lifecycle FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def z23_fact_timeline(t: Tables) -> DataFrame:
    after = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_id", "ts", after.alias("superseded_at"), F.when(after.isNull(), "current").otherwise("superseded").alias("lifecycle"))


# --- text, digests and canonical forms


@query("SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def x05_sentences(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.size(dg.sentences(F.col("text"))).alias("n"))


@query("SELECT event_id, json_valid(props) AS complete FROM events")
def x15_complete_json(t: Tables) -> DataFrame:
    return t("events").select("event_id", tr.valid_json(F.col("props")).alias("complete"))


@query("SELECT doc_id, length(trim(text)) BETWEEN 1 AND 120 AND NOT contains(text, chr(10)) AS valid FROM documents")
def x22_subject_line(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", dg.subject_line(F.col("text")).alias("valid"))


@query("SELECT p_partkey, CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS hash FROM part")
def x35_fnv1a(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", dg.fnv1a_64(F.col("p_name")).alias("hash"))


@query("SELECT doc_id, sha256(from_hex('" + bytes(x ^ 0x5C for x in b"lodestone".ljust(64, b"\0")).hex() + "') || from_hex(sha256(from_hex('" + bytes(x ^ 0x36 for x in b"lodestone".ljust(64, b"\0")).hex() + "') || encode(text)))) AS tag FROM documents")
def d37_keyed_digest(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", dg.hmac_sha256(b"lodestone", F.col("text")).alias("tag"))


@query("SELECT p_partkey, regexp_replace(left(sha256(p_name), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS row_key FROM part")
def d38_row_key(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", dg.row_key(F.col("p_name")).alias("row_key"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(greatest(round_even(l_discount * 1000 / 8 * 100, 0), -2147483648), 2147483647) AS INTEGER) AS impact FROM lineitem")
def d28_impact(t: Tables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", F.least(F.greatest(F.rint(F.col("l_discount") * 1000 / 8 * 100), F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int").alias("impact"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS total FROM embeddings")
def d19_unit_vectors(t: Tables) -> DataFrame:
    unit = F.transform("embedding", lambda x: x.cast("double") / sc.norm(F.col("embedding")))
    return t("embeddings").select("vec_id", r6(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT o_orderkey, field, value FROM (SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS field, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS value FROM orders) WHERE value IS NOT NULL")
def y05_attributes(t: Tables) -> DataFrame:
    return scoring.attributes(t("orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("SELECT o_orderkey, 'price=' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS VARCHAR) || ';recent=' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS VARCHAR) AS lanes FROM orders")
def y04_lane_ranks(t: Tables) -> DataFrame:
    rank = lambda c: F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(c), "o_orderkey")).cast("string")
    return t("orders").select("o_orderkey", F.concat(F.lit("price="), rank("o_totalprice"), F.lit(";recent="), rank("o_orderdate")).alias("lanes"))
