"""Recall: lanes over stored postings and embeddings, their fusion, and the queries made of them, with their SQL.

The test tables stand in: a document's vector is that of the same number in embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import schema
from lodestone.functions import scalars as sc
from lodestone.operators import index, search
from lodestone.plans.catalog import _BM, _QUERY
from lodestone.plans.registry import ORACLES, QUERIES, Tables, query

#: The words asked for, and the vector that asks.
WORDS, PROBE = _QUERY, 1
#: How deep a lane goes for a limit of 10, the rank constant, lane weights.
DEPTH, RRF = max(4 * 10, 32), 60
LEXICAL, DENSE = 0.4, 0.6

Recall = Callable[["Lanes"], DataFrame]


class Lanes:
    """The lanes of one data folder; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def records(self) -> DataFrame:
        return schema.records(self.table("documents"))

    def lexical(self) -> DataFrame:
        """doc_id, score of all documents with a word."""
        return index.matches(self.spark, index.index_of(self.spark, f"{self.sf_dir}/documents.parquet"), WORDS)

    def cosines(self) -> DataFrame:
        """doc_id, label, cosine to the probe."""
        e = self.table("embeddings")
        probe = e.where(F.col("vec_id") == PROBE).limit(1).select(F.col("embedding").alias("q"))
        return e.join(F.broadcast(probe)).select(F.col("vec_id").alias("doc_id"), "label", F.round(sc.cosine(F.col("embedding"), F.col("q")), 9).alias("cosine"))

    def lane(self, which: str, depth: int = DEPTH) -> DataFrame:
        """doc_id, rank of the best of a lane."""
        scored = self.lexical().withColumnRenamed("score", "s") if which == "lexical" else self.cosines().withColumnRenamed("cosine", "s")
        return search.ranked(search.top(scored, "s", depth, "doc_id"), "s", "doc_id").select("doc_id", "rank")

    def pool(self, lexical: float = LEXICAL, dense: float = DENSE) -> DataFrame:
        """doc_id, score, lanes: both lanes fused (twice DEPTH rows at most)."""
        both = search.fused({"lexical": (self.lane("lexical"), lexical), "dense": (self.lane("dense"), dense)}, "doc_id", RRF)
        return both.select("doc_id", F.round("score", 9).alias("score"), F.col("lanes").cast("long").alias("lanes"))

    def best(self, df: DataFrame, k: int = 10) -> DataFrame:
        return df.orderBy(F.col("score").desc(), "doc_id").limit(k)


_COS = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(p.embedding[i] AS DOUBLE))) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(p.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 9)"
_LANES = f"""{_BM}, cs AS (SELECT e.vec_id AS doc_id, e.label, {_COS} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) p),
ll AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY rank LIMIT {DEPTH}), dl AS (SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) AS rank FROM cs ORDER BY rank LIMIT {DEPTH}), {schema.RECORDS_SQL}"""


def _pool(lexical: float = LEXICAL, dense: float = DENSE) -> str:
    return f"{_LANES}, pool AS (SELECT doc_id, round(sum(m), 9) AS score, CAST(bit_or(lane) AS BIGINT) AS lanes FROM (SELECT doc_id, {lexical} / ({RRF} + rank) AS m, 1 AS lane FROM ll UNION ALL SELECT doc_id, {dense} / ({RRF} + rank), 2 FROM dl) GROUP BY 1)"


def recall(sql: str) -> Callable[[Recall], Recall]:
    def register(f: Recall) -> Recall:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Lanes(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return register


@recall(_BM + " SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 25")
def t07_bm25(x: Lanes) -> DataFrame:
    return x.best(x.lexical(), 25)


@recall(_pool() + " SELECT p.doc_id, score, lanes, lang, n_chars FROM (SELECT * FROM pool ORDER BY score DESC, doc_id LIMIT 10) p JOIN documents USING (doc_id)")
def q01_hybrid_recall(x: Lanes) -> DataFrame:
    return x.table("documents").join(F.broadcast(x.best(x.pool())), "doc_id").select("doc_id", "score", "lanes", "lang", "n_chars")


QUERIES["j03_hydration"] = lambda spark, sf_dir: QUERIES["q01_hybrid_recall"](spark, sf_dir).select("doc_id", "lang", "n_chars")
ORACLES["j03_hydration"] = f"SELECT doc_id, lang, n_chars FROM ({ORACLES['q01_hybrid_recall']})"


@recall(_LANES + " SELECT label, doc_id, rank FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, doc_id) AS rank FROM cs) WHERE rank <= 5")
def q02_float_lane(x: Lanes) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "doc_id"))
    return x.cosines().select("label", "doc_id", rank.cast("long").alias("rank")).where("rank <= 5")


def _composed(x: Lanes) -> DataFrame:
    """The pool with the parts that compositions weigh: rank mass, cosine, field fit, recency; all on [0, 1]."""
    pool = x.pool()
    rows = x.records().select("doc_id", (schema.TRUST.value() / 63).alias("trust"), F.exp(-F.col("doc_id") / 500.0).alias("recent"))
    top = pool.agg(F.max("score").alias("most"))
    return pool.join(F.broadcast(top)).join(x.cosines().select("doc_id", "cosine"), "doc_id", "left").join(rows, "doc_id", "left").select("doc_id", (F.col("score") / F.col("most")).alias("text"), F.coalesce("cosine", F.lit(0.0)).alias("vector"), F.coalesce("trust", F.lit(0.0)).alias("matrix"), F.coalesce("recent", F.lit(0.0)).alias("temporal"))


#: Compositions: the weight of each part.
COMPOSITIONS = {"balanced": {"text": 0.4, "vector": 0.4, "matrix": 0.1, "temporal": 0.1}, "lexical": {"text": 1.0}, "fresh": {"text": 0.3, "temporal": 0.7}, "distrust": {"text": 0.8, "matrix": -0.2}}
_PARTS = _pool() + ", parts AS (SELECT p.doc_id, p.score / (SELECT max(score) FROM pool) AS text, coalesce(cs.cosine, 0) AS vector, coalesce(((r.adjective >> 18) & 63) / 63.0, 0) AS matrix, coalesce(exp(-p.doc_id / 500.0) * CASE WHEN r.doc_id IS NULL THEN NULL ELSE 1 END, 0) AS temporal FROM pool p LEFT JOIN cs USING (doc_id) LEFT JOIN r USING (doc_id))"


def _weighed(weights: dict[str, float]) -> Column:
    return F.round(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 6)


def _weighed_sql(weights: dict[str, float]) -> str:
    return "round(" + " + ".join(f"{c} * {w}" for c, w in weights.items()) + ", 6)"


@recall(_PARTS + " ".join([" SELECT * FROM (", " UNION ALL ".join(f"SELECT '{k}' AS composition, doc_id, {_weighed_sql(w)} AS score FROM parts" for k, w in COMPOSITIONS.items()), ")"]))
def q05_composition_grid(x: Lanes) -> DataFrame:
    grid = F.array(*(F.struct(F.lit(k).alias("composition"), _weighed(w).alias("score")) for k, w in COMPOSITIONS.items()))
    return _composed(x).select("doc_id", F.inline(grid)).select("composition", "doc_id", "score")


_PRECISE = f"SELECT doc_id, {_weighed_sql(COMPOSITIONS['balanced'])} AS score FROM (SELECT parts.* FROM parts JOIN (SELECT doc_id FROM pool ORDER BY score DESC, doc_id LIMIT 30) USING (doc_id)) ORDER BY score DESC, doc_id LIMIT 10"


def _precise(x: Lanes) -> DataFrame:
    thirty = x.best(x.pool(), 30).select("doc_id")
    return x.best(_composed(x).join(F.broadcast(thirty), "doc_id", "left_semi").select("doc_id", _weighed(COMPOSITIONS["balanced"]).alias("score")))


@recall(_PARTS + " " + _PRECISE)
def q04_precise_recall(x: Lanes) -> DataFrame:
    return _precise(x)


@recall(_pool(1.0, -0.5) + " SELECT doc_id, score, lanes FROM pool ORDER BY score DESC, doc_id LIMIT 10")
def q06_shaped_recall(x: Lanes) -> DataFrame:
    return x.best(x.pool(1.0, -0.5))


#: Lane weights by preset name; a name that isn't here steers nothing.
PRESETS = {"keywords": (2.0, 0.5), "meaning": (0.5, 2.0), "not_like_this": (1.0, -1.0)}


@recall(" UNION ALL ".join(f"SELECT * FROM ({_pool(*PRESETS.get(p, (LEXICAL, DENSE)))} SELECT '{p}' AS preset, doc_id, score FROM pool ORDER BY score DESC, doc_id LIMIT 5)" for p in ("keywords", "meaning", "not_like_this", "unknown")))
def z17_presets(x: Lanes) -> DataFrame:
    from lodestone.operators.storage import union

    return union([x.best(x.pool(*PRESETS.get(p, (LEXICAL, DENSE))), 5).select(F.lit(p).alias("preset"), "doc_id", "score") for p in ("keywords", "meaning", "not_like_this", "unknown")])


@recall(_pool() + ", o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM pool) SELECT doc_id, round(1.0 / (rank + 60) + CASE WHEN r.event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' THEN 0.003 ELSE 0 END + CASE WHEN r.provenance & 63 = 3 THEN 0.003 ELSE 0 END, 9) AS score FROM o JOIN r USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def q07_session_hybrid(x: Lanes) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # over the bounded pool
    inside = F.col("event_time").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))
    boost = F.when(inside, 0.003).otherwise(0.0) + F.when(schema.SOURCE_TYPE.value() == 3, 0.003).otherwise(0.0)
    rows = x.records().join(F.broadcast(x.pool().select("doc_id", rank.alias("rank"))), "doc_id")
    return x.best(rows.select("doc_id", F.round(1.0 / (F.col("rank") + RRF) + boost, 9).alias("score")))


@recall(f"{_PARTS}, o AS (SELECT score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM pool), g AS (SELECT (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / max(score) FILTER (rank = 1) >= 0.25 AS sure FROM o WHERE rank <= 2) SELECT CASE WHEN sure THEN 1 ELSE 2 END AS stage, doc_id, score FROM g, (SELECT true AS one, * FROM (SELECT doc_id, score FROM pool ORDER BY score DESC, doc_id LIMIT 10) UNION ALL SELECT false, * FROM ({_PRECISE})) z WHERE z.one = g.sure")
def q08_walk_recall(x: Lanes) -> DataFrame:
    top = x.best(x.pool(), 2).agg(F.max("score").alias("a"), F.min("score").alias("b"))
    gap = top.select(((F.col("a") - F.col("b")) / F.col("a") >= 0.25).alias("sure"))
    both = x.best(x.pool()).select(F.lit(True).alias("sure"), "doc_id", "score").unionByName(_precise(x).select(F.lit(False).alias("sure"), "doc_id", "score"))
    return both.join(F.broadcast(gap), "sure").select(F.when(F.col("sure"), 1).otherwise(2).alias("stage"), "doc_id", "score")


@recall(_LANES + f" SELECT doc_id, cosine AS score FROM cs WHERE doc_id <> {PROBE} ORDER BY score DESC, doc_id LIMIT 10")
def q11_similar_recall(x: Lanes) -> DataFrame:
    return x.best(x.cosines().where(F.col("doc_id") != PROBE).select("doc_id", F.col("cosine").alias("score")))


@recall(r"SELECT conv_id, turn, CAST(n AS BIGINT) AS n FROM (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}0-9]+'), lambda w: w IN ('the', 'and', 'idiot', 'version'))) AS n FROM conversations WHERE role = 'user') WHERE n > 0 ORDER BY n DESC, conv_id, turn LIMIT 20")
def q12_transcript_recall(x: Lanes) -> DataFrame:
    c = x.table("conversations").where("role = 'user'")
    n = F.size(F.filter(sc.tokens(F.col("text")), lambda w: w.isin(list(WORDS)))).cast("long")
    return c.select("conv_id", "turn", n.alias("n")).where("n > 0").orderBy(F.desc("n"), "conv_id", "turn").limit(20)


@recall(_LANES + ", v AS (SELECT doc_id, lineage_id, cosine FROM r JOIN cs USING (doc_id) WHERE operational & 1048576 <> 0 ORDER BY cosine DESC, doc_id LIMIT 5), c AS (SELECT v.doc_id AS hit, r.doc_id, row_number() OVER (PARTITION BY v.doc_id ORDER BY r.doc_id) AS n FROM v JOIN r ON r.lineage_id = v.lineage_id AND r.doc_id <> v.doc_id) SELECT hit, doc_id FROM c WHERE n <= 3 ORDER BY hit, doc_id LIMIT 10")
def q13_vague_recall(x: Lanes) -> DataFrame:
    r = x.records().select("doc_id", "lineage_id", "operational")
    vague = r.where(F.col("operational").bitwiseAND(F.lit(schema.VAGUE)) != 0).join(x.cosines(), "doc_id").select("doc_id", "lineage_id", F.col("cosine").alias("score"))
    hits = x.best(vague, 5).select(F.col("doc_id").alias("hit"), "lineage_id")
    near = r.select("doc_id", "lineage_id").join(F.broadcast(hits), "lineage_id").where("doc_id <> hit")
    few = near.withColumn("n", F.row_number().over(Window.partitionBy("hit").orderBy("doc_id"))).where("n <= 3")
    return few.select("hit", "doc_id").orderBy("hit", "doc_id").limit(10)


@recall(_pool() + " SELECT wing, string_agg(CAST(doc_id AS VARCHAR) || ':' || room, ';' ORDER BY doc_id) AS document, count(*) AS n FROM (SELECT doc_id FROM pool ORDER BY score DESC, doc_id LIMIT 10) p JOIN r USING (doc_id) GROUP BY wing")
def q16_context(x: Lanes) -> DataFrame:
    rows = x.records().join(F.broadcast(x.best(x.pool()).select("doc_id")), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "room")))  # of at most ten rows
    return rows.groupBy("wing").agg(F.array_join(F.transform(ordered, lambda d: F.concat(d["doc_id"].cast("string"), F.lit(":"), d["room"])), ";").alias("document"), F.count(F.lit(1)).alias("n"))


@recall(_pool() + " SELECT doc_id, lanes & 1 = 1 AS lexical, lanes & 2 = 2 AS dense, round(score - CASE WHEN lanes & 2 = 2 THEN 0 ELSE score END, 9) AS shared FROM pool")
def q36_explained(x: Lanes) -> DataFrame:
    has = lambda bit: F.col("lanes").bitwiseAND(F.lit(bit)) == bit
    return x.pool().select("doc_id", has(1).alias("lexical"), has(2).alias("dense"), F.round(F.when(has(2), F.col("score")).otherwise(0.0), 9).alias("shared"))


@recall(_pool() + " SELECT avg(bit_count(lanes)) / 2.0 AS agreement, round(stddev_pop(score), 9) AS sharpness FROM pool")
def a54_agreement(x: Lanes) -> DataFrame:
    return x.pool().agg((F.avg(F.bit_count("lanes")) / 2.0).alias("agreement"), F.round(F.stddev_pop("score"), 9).alias("sharpness"))


@recall(_LANES + " SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1 END + CASE WHEN b.doc_id IS NULL THEN 0 ELSE 2 END AS mask, least(a.rank, b.rank) AS best FROM ll a FULL JOIN dl b ON a.doc_id = b.doc_id")
def j02_union_best(x: Lanes) -> DataFrame:
    lane = lambda which, bit: x.lane(which).select("doc_id", F.lit(bit).alias("mask"), F.col("rank").cast("long").alias("best"))
    return lane("lexical", 1).unionByName(lane("dense", 2)).groupBy("doc_id").agg(F.bit_or("mask").alias("mask"), F.min("best").alias("best"))


_SPANNED = _LANES + ", h AS (SELECT doc_id, rank FROM ll WHERE rank <= 30), s AS (SELECT h.doc_id, max(cs.cosine) AS span FROM h JOIN cs ON cs.doc_id % 30 = h.doc_id % 30 GROUP BY 1), q AS (SELECT doc_id, row_number() OVER (ORDER BY span DESC, doc_id) AS span_rank FROM s)"


def _spans(x: Lanes) -> DataFrame:
    """doc_id, rank, span: the head of the lexical lane with the best vector of each document (vectors are its spans by number)."""
    head = x.lane("lexical").where("rank <= 30").withColumn("slot", F.col("doc_id") % 30)
    spans = x.cosines().select((F.col("doc_id") % 30).alias("slot"), "cosine")
    best = spans.join(F.broadcast(head.select("slot").distinct()), "slot").groupBy("slot").agg(F.max("cosine").alias("span"))
    return head.join(best, "slot").select("doc_id", "rank", "span")


@recall(_SPANNED + " SELECT doc_id, span FROM s")
def j04_head_spans(x: Lanes) -> DataFrame:
    return _spans(x).select("doc_id", "span")


@recall(_SPANNED + " SELECT ll.doc_id, round(1.0 / (60 + ll.rank) + coalesce(1.0 / (60 + q.span_rank), 0), 9) AS score FROM ll LEFT JOIN q USING (doc_id)")
def j05_span_fusion(x: Lanes) -> DataFrame:
    ranks = _spans(x).select("doc_id", F.row_number().over(Window.orderBy(F.desc("span"), "doc_id")).alias("span_rank"))
    return x.lane("lexical").join(ranks, "doc_id", "left").select("doc_id", F.round(1.0 / (RRF + F.col("rank")) + F.coalesce(1.0 / (RRF + F.col("span_rank")), F.lit(0.0)), 9).alias("score"))


QUERIES["q35_span_rerank"] = lambda spark, sf_dir: QUERIES["j05_span_fusion"](spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(10)
ORACLES["q35_span_rerank"] = f"SELECT * FROM ({ORACLES['j05_span_fusion']}) ORDER BY score DESC, doc_id LIMIT 10"


@recall(_LANES + ", m AS (SELECT vec_id AS doc_id, q, max(c) AS near FROM (SELECT e.vec_id, p.vec_id AS q, list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(p.embedding[i] AS DOUBLE))) AS c FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 4) p) GROUP BY 1, 2) SELECT doc_id, round(sum(near), 5) AS score FROM m GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def t08_late_interaction(x: Lanes) -> DataFrame:
    """Each of a few question vectors takes its nearest part of a document; here a document has one part."""
    e = x.table("embeddings")
    asked = e.where("vec_id < 4").limit(4).select(F.col("vec_id").alias("part"), F.col("embedding").alias("q"))
    near = e.join(F.broadcast(asked)).groupBy(F.col("vec_id").alias("doc_id"), "part").agg(F.max(sc.dot(F.col("embedding"), F.col("q"))).alias("near"))
    return x.best(near.groupBy("doc_id").agg(F.round(F.sum("near"), 5).alias("score")), 20)


@query("SELECT 10 AS lim, CAST(least(greatest(10 * 4, 64), 256) AS INTEGER) AS frontier, CAST(greatest(10 * 4, 32) AS INTEGER) AS candidates UNION ALL SELECT 100, 256, 400")
def t15_depths(t: Tables) -> DataFrame:
    spark = t("region").sparkSession
    return spark.createDataFrame([(n, search.frontier(n), search.candidates(n)) for n in (10, 100)], "lim int, frontier int, candidates int")
