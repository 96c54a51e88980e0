"""N-gram Jaccard self-join as a blocked sparse matrix product.

The document by n-gram incidence matrix A has a row for each distinct set of
shingles and a column for each shingle hash; the join asks for the entries of
A A^T that reach the threshold.  Bounds derived from the sizes decide which
part of the product is formed at all:

* A set of n shingles has a partner only if the partner misses at most
  d = n - ceil(t n) of them.  Of each row only the p = d + l least hashes are
  multiplied, l = l(n) > 0: two similar rows share at least min(l, l') there.
* A column held by one row only adds nothing, and a row with fewer shared
  columns than l at the least size a partner can have is discarded.
* Of what is left, in the order of rising column counts, all but the first
  (shared - l + 1) entries are discarded as well: a similar pair meets in one
  of the rare columns.

The product is formed in blocks: the surviving rows are cut into PARTS ranges
of columns, a task multiplies one range of two rows, and the overlaps of a row
pair are accumulated over all ranges and held against the bound of its sizes,
so every reported link is exact.  See links.py for how pairs inside groups of
near copies are avoided; equal sets are one row of the matrix.

Shingles are 64-bit hashes of the words; at 10**9 distinct shingles the
chance that any two of them collide is 3 %, and a collision changes an
overlap by one.

Defined results: a null or empty text, or one without words, has the empty
set, links with nothing and is its own component; repeated rows are in one
component and each keep their row; an empty table gives an empty table; only
doc_id and text are read.  A row with a null doc_id links with nothing and has
a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import if_small, written
from lodestone.llm.links import linked_components, verified
from lodestone.llm.textvec import chunked, lists, mix, signed, utf8

#: Entries multiplied of each row beyond the d that a partner may lack, as a share of its size.
EXTRA = 0.06
#: Ranges of columns in which the product is formed.
PARTS = 4
#: Longs of a row's sketch.
SKETCH = 8


def extra(n: np.ndarray) -> np.ndarray:
    """l(n): rises with n."""
    return np.ceil(EXTRA * n).astype(np.int64) + 1


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """d(n) = n - ceil(percent n / 100)."""
    return n - -(-percent * n // 100)


def _sets(texts: list[bytes], k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each document) for chunks of texts."""
    for w in chunked(texts):
        shingles, at = w.shingles(k)
        out = []
        for i in range(len(at) - 1):
            own = np.sort(shingles[at[i] : at[i + 1]])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
        yield w.first_row, out


def _name(own: np.ndarray) -> np.uint64:
    """A hash of a set."""
    return mix(np.array([mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]


def parity(own: np.ndarray, longs: int) -> np.ndarray:
    """The parity sketch of a set (see links.py)."""
    odd = np.bincount((own & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n (set size), node (hash of the set), need (least overlap inside the part), part (the multiplied entries, none for
    a set that its task has seen before or that has no doc_id) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for first, sets in _sets(utf8(b.column(1)), k):
                n = np.array([len(s) for s in sets], np.int64)
                size = np.minimum(n, missing(n, percent) + extra(n))
                need = np.minimum(size, extra(-(-percent * n // 100)))
                names = np.array([_name(s) if len(s) else 0 for s in sets], np.uint64)
                known = np.asarray(b.column(0).slice(first, len(n)).is_valid())
                for i, name in enumerate(names.tolist()):  # a task multiplies copies of a row once
                    if name in seen or not known[i]:
                        size[i] = 0
                    else:
                        seen.add(name)
                cut = np.concatenate(([0], np.cumsum(size)))
                flat = np.concatenate([*(s[:p] for s, p in zip(sets, size, strict=True)), np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n), pa.array(signed(names)), pa.array(need), lists(signed(flat), cut), lists(np.concatenate([parity(s, SKETCH) for s in sets]), np.arange(len(n) + 1) * SKETCH)], ["doc_id", "n", "node", "need", "part", "sketch"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n long, node long, need long, part array<long>, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """Blocks of the incidence matrix: node, part (range of hashes), n (size of the whole set) and the set's items in
    that range; a set that many documents have comes once for each."""
    edges = np.array([i << (64 - PARTS.bit_length() + 1) for i in range(1, PARTS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in _sets(utf8(b.column(0)), k):
                sets = [s for s in sets if len(s)]
                inner = np.array([np.concatenate(([0], np.searchsorted(s, edges), [len(s)])) for s in sets], np.int64).reshape(-1, PARTS + 1)
                size = np.diff(inner, axis=1)
                names = np.array([_name(s) for s in sets], np.uint64)
                row, part = np.nonzero(size)
                cut = np.concatenate(([0], np.cumsum(size[row, part])))
                items = np.concatenate([*sets, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(names[row])), pa.array(part.astype(np.int32)), pa.array(inner[row, -1].astype(np.int32)), lists(signed(items), cut)], ["node", "part", "n", "items"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, part int, n int, items array<long>")


def _once(sets: DataFrame) -> DataFrame:
    """sets (with uid) with one row of each node and part.

    Only rows that repeat an id come twice, so copies are looked for by their
    names, and the items are not shuffled.
    """
    copies = written(sets.groupBy("node", "part").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("node", "part", "first"), "copies")
    if copies.isEmpty():
        return sets.drop("uid")
    return written(sets.join(if_small(copies), ["node", "part"], "left").where("first is null or uid = first").drop("uid", "first"), "sets")


def _kept_columns(table: DataFrame) -> DataFrame:
    """Blocks (block, node, n, rank): the rare shared columns of each row that
    pass its bounds; rank: the entries of the part that no other row has."""
    entries = table.where("n > 0 and doc_id is not null").select("node", "n", "need", F.size("part").alias("size"), F.explode("part").alias("block"))
    # a table of its own: few blocks are shared, and the count's shuffle is gone before the join's begins
    shared = entries.groupBy("block").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("df")).where("low <> high")
    shared = written(shared.select("block", "df"), "shared")
    held = entries.join(shared, "block").groupBy("node", "n", "need", "size").agg(F.array_sort(F.collect_set(F.struct("df", "block"))).alias("columns"))
    keep = F.size("columns") - F.col("need") + 1
    held = held.where(keep > 0).select("node", "n", (F.col("size") - F.size("columns")).alias("rank"), F.explode(F.slice("columns", F.lit(1), keep.cast("int"))).alias("c"))
    return held.select(F.col("c.block").alias("block"), "node", "n", "rank")


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, node, component_id): components of documents
    whose sets of k-word shingles have a Jaccard similarity of percent / 100
    or more; component_id is the least doc_id of the component."""
    table = written(rows(docs, k, percent), "incidence")
    blocks = written(_kept_columns(table), "columns")
    nodes = written(blocks.select("node").distinct(), "nodes")
    # one document of each set that is left, to take the whole set from
    chosen = written(table.select("node", "doc_id").join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "chosen")
    sources = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(if_small(chosen), "doc_id", "left_semi")
    sets = _once(written(full_sets(sources, k).withColumn("uid", F.monotonically_increasing_id()), "sets"))
    found = linked_components(blocks, table.select("node", "sketch"), SKETCH, percent, lambda pairs: verified(pairs, sets, percent))
    labelled = table.select("doc_id", F.col("n").alias("n_shingles"), "node").join(found, "node", "left").withColumn("group", F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "node")))
    # a table of its own, so that a hot group's rows can be split in the join
    names = written(labelled.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "names")
    return labelled.join(names, "group", "left").select("doc_id", "n_shingles", "node", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each component: the largest set, then the least doc_id.

    Which id stays is decided by an aggregation with a partial step, never by
    a window over a component.  A row without doc_id is known by a hash of its
    text and gives way to a row with an id; of rows that repeat an id one stays.
    """
    end = -(1 << 62)  # hashes stand below it
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), 2))
    best = F.max(F.struct("n_shingles", (F.col("doc_id") >= end).alias("real"), (-F.col("doc_id")).alias("back"), "doc_id"))
    ids = join(docs.select(known.alias("doc_id"), "text"), k, percent).groupBy("component_id").agg(best.alias("best")).select(F.col("best.doc_id").alias("_known"))
    once = docs.withColumn("_known", known).join(ids, "_known", "left_semi")
    order = Window.partitionBy("_known").orderBy(F.length("text").desc_nulls_last(), "text")
    return once.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS g
  FROM d
), c AS (SELECT array_to_string(list_sort(g), chr(10)) AS key, min(doc_id) AS rep, any_value(g) AS g FROM s WHERE len(g) > 0 GROUP BY 1
), e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c
), p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)
), r AS (
  SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.g) > 0 AND c.key = array_to_string(list_sort(s.g), chr(10)) LEFT JOIN m ON m.node = c.rep
"""
