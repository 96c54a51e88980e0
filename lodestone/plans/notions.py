"""Derivations, concepts and implications of formal contexts, content fingerprints and their lane, the causality stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import concepts as fca
from lodestone.operators import fingerprints
from lodestone.operators.storage import written
from lodestone.plans.registry import Tables, query
from lodestone.streaming import causality, twins

_CLASSES = "cls AS (SELECT list_sort(['flag=' || l_returnflag, 'status=' || l_linestatus, 'line=' || l_linenumber, 'tax=' || CAST(round(l_tax * 100) AS INTEGER)]) AS xs, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT DISTINCT unnest(xs) AS x FROM cls)"
_ASKED = "q AS (SELECT []::VARCHAR[] AS s UNION SELECT [x] FROM u UNION SELECT [a.x, b.x] FROM u a JOIN u b ON a.x < b.x)"
_CLOSED = "m AS (SELECT q.s, cls.xs, cls.n FROM q JOIN cls ON list_has_all(cls.xs, q.s)), e AS (SELECT q.s, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS extent FROM q LEFT JOIN m USING (s) GROUP BY 1), k AS (SELECT q.s, list_sort(list(u.x)) AS closed FROM q, u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = q.s AND NOT list_contains(m.xs, u.x)) GROUP BY 1), c AS (SELECT e.s, e.extent, coalesce(k.closed, []::VARCHAR[]) AS closed FROM e LEFT JOIN k USING (s))"


def _lines(t: Tables) -> fca.Context:
    """Lines by return flag, status, number and tax in hundredths."""
    tax = F.round(F.col("l_tax") * 100).cast("int")
    cells = (F.concat(F.lit(k + "="), c) for k, c in (("flag", F.col("l_returnflag")), ("status", F.col("l_linestatus")), ("line", F.col("l_linenumber")), ("tax", tax)))
    return fca.context(t("lineitem").select(F.array(*cells).alias("items")))


def _joined(c: str) -> Column:
    return F.array_join(c, ";").alias(c)


@query(f"WITH {_CLASSES}, {_ASKED}, {_CLOSED} SELECT array_to_string(s, ';') AS intent, extent, array_to_string(closed, ';') AS closed FROM c")
def z09_closures(t: Tables) -> DataFrame:
    """Extent and closure of the empty intent, of every attribute and of every pair, those that no line holds too."""
    ctx = _lines(t)
    every = ctx.attributes.agg(F.array_sort(F.collect_list("item")).alias("xs"))
    one = every.select("xs", F.posexplode("xs").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b")).select(F.array("a", "b").alias("intent"))
    asked = two.union(one.select(F.array("a"))).union(every.select(F.array().cast("array<string>")))
    return fca.closures(ctx, asked).select(_joined("intent"), "extent", _joined("closed"))


@query("WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 2) SELECT 'brand=' || p_brand || ';type=' || p_type AS intent, p_partkey FROM part JOIN a USING (p_brand, p_type)")
def z09_extents(t: Tables) -> DataFrame:
    """All parts that share brand and type with one of the two smallest sizes."""
    cells = F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), F.col("p_size")))
    p = t("part").select("p_partkey", "p_size", cells.alias("items"))
    asked = p.where("p_size <= 2").select(F.slice("items", 1, 2).alias("intent"))
    return fca.extents(p, "p_partkey", asked).select(_joined("intent"), "p_partkey")


@query(f"WITH RECURSIVE {_CLASSES}, c AS (SELECT xs FROM cls UNION SELECT list_sort(list_intersect(c.xs, cls.xs)) FROM c, cls) SELECT array_to_string(c.xs, ';') AS intent, CAST(sum(n) AS BIGINT) AS support FROM c JOIN cls ON list_has_all(cls.xs, c.xs) WHERE len(c.xs) > 0 GROUP BY 1 HAVING sum(n) >= 20")
def g14_concepts(t: Tables) -> DataFrame:
    """Every concept of 20 lines or more; the SQL intersects rows, the plan extends intents."""
    return fca.concepts(_lines(t), 20).select(_joined("intent"), "support")


@query(f"WITH {_CLASSES}, {_ASKED}, {_CLOSED}, p0 AS (SELECT * FROM c WHERE len(s) = 0 AND s <> closed), p1 AS (SELECT * FROM c WHERE len(s) = 1 AND s <> closed AND NOT EXISTS (SELECT 1 FROM p0 WHERE NOT list_has_all(c.s, p0.closed))), p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1), p2 AS (SELECT * FROM c WHERE len(s) = 2 AND s <> closed AND NOT EXISTS (SELECT 1 FROM p WHERE list_has_all(c.s, p.s) AND NOT list_has_all(c.s, p.closed))) SELECT array_to_string(s, ';') AS premise, array_to_string(list_sort(list_filter(closed, lambda x: NOT list_contains(s, x))), ';') AS conclusion, extent AS support FROM (SELECT * FROM p UNION ALL SELECT * FROM p2)")
def g16_implications(t: Tables) -> DataFrame:
    """The canonical basis of premises of two attributes at most."""
    return fca.implications(_lines(t), 2).select(_joined("premise"), _joined("conclusion"), "support")


_HASHES = "s AS (SELECT DISTINCT doc_id, CASE WHEN length(low) < 3 THEN low ELSE substr(low, CAST(i AS BIGINT), 3) END AS shingle FROM (SELECT doc_id, low, unnest(range(1, greatest(length(low) - 1, 2))) AS i FROM (SELECT doc_id, lower(text) AS low FROM documents)) WHERE low <> ''), h AS (SELECT shingle, k, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, 3 + octet_length(encode(shingle))), lambda i: ('0x' || substr(hex(encode('c' || k || ':' || shingle)), CAST(2 * i + 1 AS BIGINT), 2))::UHUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS hash FROM (SELECT DISTINCT shingle FROM s), (SELECT unnest(range(0, 4)) AS k)), w AS (SELECT shingle, k, CAST(hash % 4294967296::UHUGEINT AS BIGINT) AS low, CAST(hash // 4294967296::UHUGEINT AS BIGINT) AS high FROM h)"
_VOTES = ", ".join(f"CAST(sum(({half} >> {i}) & 1) * 2 > count(*) AS HUGEINT) * {1 << i}::HUGEINT AS {half}{i}" for half in ("low", "high") for i in range(32))
_PRINTS = f"{_HASHES}, v AS (SELECT doc_id, k, {_VOTES} FROM s JOIN w USING (shingle) GROUP BY 1, 2), n AS (SELECT doc_id, k, ({' + '.join(f'low{i}' for i in range(32))}) + ({' + '.join(f'high{i}' for i in range(32))}) * 4294967296::HUGEINT AS z FROM v), f AS (SELECT d.doc_id, " + ", ".join(f"CAST(coalesce(max(CASE WHEN z >= 9223372036854775808::HUGEINT THEN z - 18446744073709551616::HUGEINT ELSE z END) FILTER (k = {j}), 0) AS BIGINT) AS b{j}" for j in range(4)) + " FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1)"


@query(f"WITH {_PRINTS} SELECT doc_id, b0, b1, b2, b3 FROM f")
def d16_content_fingerprints(t: Tables) -> DataFrame:
    """The 256-bit content fingerprint of every whole text."""
    return fingerprints.content_fingerprints(t("documents"), "doc_id", "text")


@query(f"WITH {_PRINTS} SELECT p.doc_id AS probe, f.doc_id, CAST(bit_count(xor(f.b0, p.b0)) AS INTEGER) + bit_count(xor(f.b1, p.b1)) + bit_count(xor(f.b2, p.b2)) + bit_count(xor(f.b3, p.b3)) AS distance FROM f, f p WHERE p.doc_id % 100 = 0 AND f.doc_id <> p.doc_id AND (p.b0 <> 0 OR p.b1 <> 0 OR p.b2 <> 0 OR p.b3 <> 0) AND (f.b0 <> 0 OR f.b1 <> 0 OR f.b2 <> 0 OR f.b3 <> 0) AND CAST(bit_count(xor(f.b0, p.b0)) AS INTEGER) + bit_count(xor(f.b1, p.b1)) + bit_count(xor(f.b2, p.b2)) + bit_count(xor(f.b3, p.b3)) <= 31")
def q39_fingerprint_lane(t: Tables) -> DataFrame:
    """Documents whose content fingerprint is within 31 bits of an asking one's."""
    f = written(d16_content_fingerprints(t), "content-prints")
    return fingerprints.near(f, f.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "probe"), "doc_id").where("probe <> doc_id")


_FOLDED = "x AS (SELECT user_id, event_type AS v, epoch_us(ts) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL), w AS (SELECT max(s) // 1000 - 7200000 AS passed FROM x)"


@query(f"WITH {_FOLDED} SELECT a.v AS source, b.v AS target, least(128, CAST(pow(2, ceil(log2(greatest((b.s - a.s) / 60000000, 1.0)))) AS INTEGER)) AS lag, count(*) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND b.s > a.s AND b.s - a.s < 15360000000, w WHERE (b.s // 92160000000 + 1) * 92160000 <= passed GROUP BY ALL")
def r21_causality_stream(t: Tables) -> DataFrame:
    """The events' file as a stream, folded up to the buckets that the watermark has passed."""
    pairs = twins.drained_file(t("events"), lambda s: causality.causality(s, "user_id", "ts", "event_id", "event_type"), "append")
    return pairs.groupBy("source", "target", "lag").agg(F.sum("n").alias("n"))
