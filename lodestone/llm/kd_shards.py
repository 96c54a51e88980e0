"""K-d tree sharding at distributed weighted medians.

A document is a point of metadata dimensions (language, source, length) with
its bytes as weight.  A node that has to become m
leaves is split along the dimension in which its points lie widest, relative
to the whole table's width, at the weighted quantile that gives floor(m/2)/m
of the bytes to the left.  Points are ordered in a dimension by value and then
by a hash of the document, so a value that a third of the rows share can be
cut through as well.

The quantile is found by refining a histogram: rows are counted into BINS
intervals of the 62-bit sort key for all nodes of a level at once, the
interval that holds the cut is cut again, until its rows weigh less than
TOLERANCE of the node.  Only the histograms (nodes x BINS rows) reach the
driver.  All levels read one written table of keys and sizes, without texts.

Law: bytes (sizes near equal).

Defined results: a null text has size 8; documents of equal text but different
id lie beside each other in no dimension's ties and may part, as the law is
one of bytes; rows of equal id and text follow each other and are parted by a
number of the row where a cut needs it; null metadata lies at 0; an empty table gives an empty table;
only doc_id, text, lang, source and n_chars are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import written

#: Intervals of a histogram, and the share of a node's weight a cut may be off by.
BINS = 2048
TOLERANCE = 0.00002
#: Bits of the value and of the tie-breaking hash in a sort key.
VALUE_BITS, TIE_BITS = 24, 38
#: Low bits of the tie that part rows of equal id and text.
ROW_BITS = 12
KEY_END = 1 << (VALUE_BITS + TIE_BITS)
#: Rows numbered in one task.
NUMBERED = 100_000


def _code(c: str) -> Column:
    """A category's place in [0, 1)."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(float(1 << 32))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort keys k0.. of the dimensions."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        _code("lang").alias("d0"),
        _code("source").alias("d1"),
        F.least(F.log2(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) / 40, F.lit(0.9999999)).alias("d2"),
    )
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash"), 64 - TIE_BITS + ROW_BITS), ROW_BITS) + F.shiftrightunsigned(F.xxhash64("row"), 64 - ROW_BITS)
    return sized.select(
        "doc_id", "size", "text_crc32", F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(7)), 1).alias("spread"),
        *(F.floor(F.col(d) * (1 << VALUE_BITS)).cast("long").bitwiseAND((1 << VALUE_BITS) - 1).alias(f"v{i}") for i, d in enumerate(("d0", "d1", "d2"))),
        tie.alias("tie"),
    ).withColumns({f"k{i}": F.shiftleft(f"v{i}", TIE_BITS) + F.col("tie") for i in range(3)})


def _beside(rows: DataFrame, columns: str, values: list[tuple[int, ...]]) -> DataFrame:
    """rows joined with a literal table of at most a row a node, whose first column is the shard."""
    literal = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in values)
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {literal} AS t({columns})")
    return rows.join(F.broadcast(table), "shard", "left")


def _widest(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """node -> (dimension, weight)."""
    dims = range(3)
    got = rows.groupBy("shard").agg(F.sum("size").alias("w"), *(F.max(f"v{i}").alias(f"hi{i}") for i in dims), *(F.min(f"v{i}").alias(f"lo{i}") for i in dims)).collect()
    whole = [max(1, max(r[f"hi{i}"] for r in got) - min(r[f"lo{i}"] for r in got)) for i in dims] if got else [1] * 3
    return {r["shard"]: (max(dims, key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i)), r["w"]) for r in got}


def _cuts(rows: DataFrame, wanted: dict[int, tuple[int, float]], weights: dict[int, int]) -> dict[int, int]:
    """node -> the sort key at which its rows are split; wanted: dimension and share of the weight below it."""
    low = dict.fromkeys(wanted, 0)
    high = dict.fromkeys(wanted, KEY_END)
    below = dict.fromkeys(wanted, 0)
    open_ = set(wanted)
    while open_:
        width = {n: max(1, -(-(high[n] - low[n]) // BINS)) for n in open_}
        ranges = [(n, wanted[n][0], low[n], high[n], width[n]) for n in sorted(open_)]
        binned = _beside(rows, "shard, dim, lo, hi, width", ranges).withColumn("k", F.expr("element_at(array(k0, k1, k2), cast(dim as int) + 1)")).where("k >= lo and k < hi")
        got: dict[int, list[tuple[int, int, int]]] = {}
        for r in binned.groupBy("shard", F.expr("(k - lo) div width").alias("bin")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            got.setdefault(r["shard"], []).append((r["bin"], r["w"], r["n"]))
        for n in list(open_):
            goal, total = wanted[n][1] * weights[n], below[n]
            for b, w, rows_in in sorted(got.get(n, [])):
                if total + w >= goal:
                    if w <= TOLERANCE * weights[n] or width[n] == 1 or rows_in == 1:
                        # the nearer edge of an interval that weighs next to nothing or holds one row
                        low[n] += (b + (total + w - goal <= goal - total)) * width[n]
                        open_.discard(n)
                    else:
                        low[n], high[n], below[n] = low[n] + b * width[n], min(high[n], low[n] + (b + 1) * width[n]), total
                    break
                total += w
            else:
                open_.discard(n)
    return low


def tree(rows: DataFrame, leaves: int) -> DataFrame:
    """rows with a column shard from 0 to leaves - 1; a node is named by its first leaf."""
    pending, level = {0: leaves}, rows.withColumn("shard", F.lit(0).cast("long"))
    while splitting := {n: m for n, m in pending.items() if m > 1}:
        found = _widest(level)
        wanted = {n: (found[n][0], (m // 2) / m) for n, m in splitting.items() if n in found}
        cuts = _cuts(level, wanted, {n: w for n, (_, w) in found.items()})
        if wanted:
            moves = [(n, wanted[n][0], cuts[n], n + splitting[n] // 2) for n in wanted]
            beyond = F.expr("element_at(array(k0, k1, k2), cast(dim as int) + 1) >= cut")
            level = _beside(level, "shard, dim, cut, beyond", moves).withColumn("shard", F.when(beyond, F.col("beyond")).otherwise(F.col("shard"))).drop("dim", "cut", "beyond")
        nexts = {n: m for n, m in pending.items() if m == 1}
        for n, m in splitting.items():
            nexts |= {n: m // 2, n + m // 2: m - m // 2}
        pending = nexts
    return level


def shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    n_shards, or as many leaves as leave each at most target_bytes.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give n_shards or target_bytes")
    rows = written(points(docs), "points")
    if n_shards is None:
        n_shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    leaves = tree(rows, n_shards).select("doc_id", "size", "text_crc32", "spread", "shard")
    # slots: number rows within hashed parts of a shard, then add what precedes the part
    parts = max(1, rows.count() // NUMBERED)
    leaves = leaves.withColumn("part", F.expr(f"spread % {parts}"))
    sums = leaves.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = sums.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("spread", "doc_id", "text_crc32", "size")) - 1
    return (
        leaves.withColumn("own", own)
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
