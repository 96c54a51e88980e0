"""Vectors made from texts: TF-IDF with a truncated SVD, and random indexing with pooling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import counted, tokens
from lodestone.operators.factors import BUCKETS, HEAD, Matrix, added, head_of, over, truncated_svd
from lodestone.operators.storage import bucketed, if_small, written

#: Entries other than 0 of a context vector.
SPARSE = 4
#: Words of a batch that are added up at once, and places of a row of sums: 134 MB of sums at most.
AT_ONCE, ACROSS = 524_288, 32


def smoothed_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf of postings (term, doc_id)."""
    held = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return held.withColumn("idf", F.greatest(F.lit(0.0), F.log((F.lit(n_docs) + 1) / (F.col("df") + 1))))


def numbered(docs: DataFrame) -> DataFrame:
    """row (doc_id), ws, tf of docs (doc_id, text): each document's words; rows of one id are one, with tf times each distinct word (else null)."""
    words = docs.where("text is not null").select(F.col("doc_id").alias("row"), tokens(F.col("text")).alias("ws"))
    if words.groupBy("row").count().where("count > 1").isEmpty():
        return words.withColumn("tf", F.lit(None).cast("array<long>"))
    cells = words.select("row", F.inline_outer(counted(F.col("ws")))).groupBy("row", "term").agg(F.sum("tf").alias("tf"))
    held = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return cells.groupBy("row").agg(held.alias("c")).select("row", F.col("c.term").alias("ws"), F.col("c.tf").alias("tf"))


def frequencies(docs: DataFrame) -> DataFrame:
    """item, df, idf of docs' words: a task counts before anything is shuffled."""
    held = docs.where("text is not null")
    words = held.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return smoothed_idf(words, held.count()).select(F.col("term").alias("item"), "df", "idf")


def coded(words: DataFrame, names: pa.Array) -> DataFrame:
    """row, ids, values, rest, counts of words (row, ws, tf): how often each distinct word stands in a row, by its place in names or, not of them, by itself."""
    sent = words.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().dictionary_encode()
            size = max(1, len(flat.dictionary))
            cell = np.repeat(np.arange(b.num_rows), np.asarray(b.column(1).value_lengths())) * size + np.asarray(flat.indices)
            own, at = np.unique(cell, return_inverse=True)
            times = np.ones(len(cell)) if b.column(2).null_count else np.asarray(b.column(2).flatten(), float)
            tf, row, word = np.bincount(at, times, len(own)).astype(float), own // size, own % size
            place = np.asarray(pc.index_in(flat.dictionary, sent.value).fill_null(-1)) if len(sent.value) else np.full(size, -1)
            known = place[word] >= 0
            lists = lambda pick, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.bincount(row[pick], minlength=b.num_rows).cumsum())).astype(np.int32)), values)
            columns = [lists(known, pa.array(place[word[known]].astype(np.int32))), lists(known, pa.array(tf[known])), lists(~known, flat.dictionary.take(pa.array(word[~known]))), lists(~known, pa.array(tf[~known]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["row", "ids", "values", "rest", "counts"])

    kind = words.schema["row"].dataType.simpleString()
    return words.mapInArrow(run, f"row {kind}, ids array<int>, values array<double>, rest array<string>, counts array<double>")


def rare(rows: DataFrame, cols: DataFrame, least: int) -> DataFrame:
    """row, item, tf, df, idf of the words of coded rows that are not of the head."""
    cells = rows.select("row", F.inline(F.arrays_zip(F.col("rest").alias("item"), F.col("counts").alias("tf"))))
    return cells.join(cols.where(F.col("df") < least), "item")


def tf_idf(docs: DataFrame, most: int = HEAD) -> Matrix:
    """The TF-IDF table of docs (doc_id, text): all of them, all words."""
    cols = written(frequencies(docs), "cols")
    least, head = head_of(cols, most)
    names = head.column("item").combine_chunks()
    rows = bucketed(coded(numbered(docs), names), "row", BUCKETS)
    cells = rare(rows, cols, least).select("row", F.col("item").alias("col"), "df", (F.col("tf") * F.col("idf")).alias("value")).where("value <> 0")
    rest = written(cells, "rest")
    return Matrix(rows.select("row", "ids", "values"), rest.where("df > 1").drop("df"), rest.where("df = 1").drop("df"), cols, least, names, np.asarray(head.column("idf"), float))


def weighted_sums(docs: DataFrame, most: int = HEAD) -> DataFrame:
    """doc_id, terms, weight, squares: each document's distinct words, and the sums of their TF-IDF and of its squares."""
    cols = written(frequencies(docs), "cols")
    least, head = head_of(cols, most)
    rows = written(coded(numbered(docs), head.column("item").combine_chunks()), "coded")
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(head.column("idf"), float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = np.asarray(b.column(1).value_lengths())
                row, x = np.repeat(np.arange(b.num_rows), n), np.asarray(b.column(2).flatten(), float) * sent.value[np.asarray(b.column(1).flatten(), int)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), *(pa.array(np.bincount(row, y, b.num_rows).astype(float)) for y in (x, x * x))], ["row", "terms", "weight", "squares"])

    kind = rows.schema["row"].dataType.simpleString()
    of_head = rows.select("row", "ids", "values").mapInArrow(run, f"row {kind}, terms long, weight double, squares double")
    x = F.col("tf") * F.col("idf")
    of_rest = rare(rows, cols, least).select("row", F.lit(1).cast("long").alias("terms"), x.alias("weight"), (x * x).alias("squares"))
    sums = of_head.where("terms > 0").unionByName(of_rest).groupBy(F.col("row").alias("doc_id"))
    return sums.agg(*(F.sum(c).alias(c) for c in ("terms", "weight", "squares")))


def unit(v: Column) -> Column:
    """A vector of length 1, however short it was; of zeros, an empty one."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scaled = F.when(most > 0, F.transform(v, lambda x: x / most)).otherwise(F.array().cast("array<double>"))  # squares of small numbers would vanish
    long_ = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(scaled), lambda s: F.transform(s, lambda x: x / long_(s)))[0]


# --- latent semantic analysis ---------------------------------------------------------------------------------------------


@dataclass
class Latent:
    """table: what it is fitted on; head: the places of table.names in the latent space; terms: item, v of all terms; values: singular values."""

    table: Matrix
    head: np.ndarray
    terms: DataFrame
    values: list[float]
    k: int

    @classmethod
    def fit(cls, docs: DataFrame, rank: int, sweeps: int = 6, most: int = HEAD) -> Latent:
        """Of docs (doc_id, text): all of them, all words; most: words of the head."""
        table = tf_idf(docs, most)
        found = truncated_svd(table, rank, sweeps)
        return cls(table, found.head, found.right, found.values, len(found.values))

    def embed(self, docs: DataFrame) -> DataFrame:
        """doc_id, v of every row: its words' places by weight, of length 1; empty where no word is known."""
        rows, nowhere = docs.select("doc_id", "text"), F.array().cast("array<double>")
        if not self.k:
            return rows.select("doc_id", nowhere.alias("v"))
        words = bucketed(coded(numbered(rows), self.table.names), "row", BUCKETS)
        met = rare(words, self.table.cols, self.table.least).join(self.terms, "item")
        rest = added(met.select("row", F.transform("v", lambda x: F.col("tf") * F.col("idf") * x).alias("v")), "row", self.k)
        sums = over(replace(self.table, rows=words.select("row", "ids", "values")), self.head, rest)
        return rows.select("doc_id").join(sums.select(F.col("item").alias("doc_id"), unit(F.col("v")).alias("v")), "doc_id", "left").select("doc_id", F.coalesce("v", nowhere).alias("v"))


# --- random indexing ------------------------------------------------------------------------------------------------------


def contexts(docs: DataFrame, window: int = 2) -> DataFrame:
    """term, context, n: how often each word stands within window places of another, over whole texts."""
    ws = docs.where("text is not null").select(tokens(F.col("text")).alias("ws")).where(F.size("ws") > 1)
    around = lambda i: F.slice("ws", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
    after = lambda i: F.slice("ws", i + 2, F.lit(window))
    each = ws.select(F.inline(F.transform("ws", lambda w, i: F.struct(w.alias("term"), F.concat(around(i), after(i)).alias("near")))))
    return each.select("term", F.explode("near").alias("context")).groupBy("term", "context").agg(F.count(F.lit(1)).alias("n"))


def _digit(term: Column, j: int, at: int, size: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{j}:"), term)), at, size), 16, 10).cast("long")


def context_vectors(pairs: DataFrame, dimension: int) -> DataFrame:
    """term, dim, value: the sum of the contexts' seeded sparse ternary vectors, SPARSE places of +1 or -1 each.

    A place is drawn from a digest of the context word, so no table of vectors
    is kept or joined; sums are of whole numbers, partial before the shuffle.
    """
    drawn = F.array(*(F.struct((_digit(F.col("context"), j, 1, 6) % dimension).cast("int").alias("dim"), (F.lit(1) - 2 * (_digit(F.col("context"), j, 7, 1) % 2)).alias("sign")) for j in range(SPARSE)))
    flat = pairs.select("term", "n", F.inline(drawn))
    return flat.groupBy("term", "dim").agg(F.sum(F.col("n") * F.col("sign")).alias("value")).where("value <> 0")


def context_sums(docs: DataFrame, dimension: int, window: int = 2) -> DataFrame:
    """What context_vectors gives for contexts(docs): term, dim, value; added up within a batch of texts, so no pair of words leaves its task.

    Words are numbered batch by batch; a place is drawn once a word of a batch.
    Sums go on as rows of ACROSS places a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            coded = texts.flatten().dictionary_encode()
            word, names = np.asarray(coded.indices), coded.dictionary
            if not len(word):
                continue
            text = np.repeat(np.arange(len(texts)), np.asarray(texts.value_lengths()))
            digests = [[hashlib.md5(f"{j}:{w}".encode()).hexdigest() for j in range(SPARSE)] for w in names.to_pylist()]
            dims = np.array([[int(d[:6], 16) % dimension for d in ds] for ds in digests])
            signs = np.array([[1 - 2 * (int(d[6], 16) % 2) for d in ds] for ds in digests])
            for at in range(0, len(word), AT_ONCE):
                held, own = np.unique(word[at : at + AT_ONCE], return_inverse=True)
                here = np.arange(at, at + len(own))
                for low in range(0, dimension, ACROSS):
                    sums = np.zeros(len(held) * ACROSS)
                    for step in (*range(-window, 0), *range(1, window + 1)):
                        there = np.clip(here + step, 0, len(word) - 1)
                        met = (here + step == there) & (text[there] == text[here])
                        term, context = own[met] * ACROSS, word[there[met]]
                        for j in range(SPARSE):
                            place = dims[context, j] - low
                            inside = (place >= 0) & (place < ACROSS)
                            sums += np.bincount(term[inside] + place[inside], signs[context[inside], j], len(sums))
                    sums = sums.reshape(-1, ACROSS).astype(np.int64)
                    some = sums.any(axis=1)
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(sums[some].ravel()), ACROSS).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(held[some])), pa.array(np.full(some.sum(), low, np.int32)), rows], ["term", "low", "v"])

    ws = docs.where("text is not null").select(tokens(F.col("text")).alias("ws")).where(F.size("ws") > 1)
    sums = ws.mapInArrow(run, "term string, low int, v array<long>").groupBy("term", "low").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(ACROSS)))
    places = F.array(*(F.struct((F.col("low") + j).alias("dim"), F.col(f"v{j}").alias("value")) for j in range(ACROSS)))
    return sums.select("term", F.inline(places)).where("value <> 0")


@dataclass
class Pooling:
    """terms: term, idf, dim, value; mean: the unit direction of the corpus, dimension long at most, or empty."""

    terms: DataFrame
    mean: dict[int, float]

    @classmethod
    def fit(cls, docs: DataFrame, dimension: int, window: int = 2) -> Pooling:
        held = docs.where("text is not null")
        idf = smoothed_idf(held.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), held.count())
        terms = written(context_sums(docs, dimension, window).join(written(idf, "idf"), "term"), "terms")
        sums = terms.groupBy("dim").agg(F.sum(F.col("df") * F.col("idf") * F.col("value")).alias("s")).collect()  # dimension rows
        length = math.sqrt(sum(r.s**2 for r in sums))
        return cls(terms, {r.dim: r.s / length for r in sums} if length > 0 else {})

    def pooled(self, docs: DataFrame) -> DataFrame:
        """doc_id, hits (distinct words with a vector), along (share of the mean direction) and v (map of place and value):
        the idf-weighted sum over distinct words, of length 1, less the mean direction, of length 1 again; null where nothing is left."""
        words = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        dims = sorted(r.dim for r in self.terms.select("dim").distinct().collect())  # dimension rows
        own = [F.coalesce(F.max(F.when(F.col("dim") == d, F.col("value"))), F.lit(0)).alias(f"v{d}") for d in dims]
        vectors = written(self.terms.groupBy("term").agg(F.first("idf").alias("idf"), *own), "vectors")
        met = words.join(if_small(vectors, 20_000), "term")
        sums = met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), *(F.sum(F.col("idf") * F.col(f"v{d}")).alias(f"s{d}") for d in dims))
        mean = F.create_map(*(F.lit(x) for pair in self.mean.items() for x in pair)) if self.mean else F.expr("map()").cast("map<int,double>")
        places = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"s{d}").alias("s")) for d in dims)) if dims else F.array().cast("array<struct<dim:int,s:double>>")
        each = written(sums.select("doc_id", "hits", places.alias("s")), "pooled")
        hits = each.select("doc_id", "hits")
        length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["s"] * x["s"]))
        first = each.select("doc_id", F.when(length > 1e-12, F.map_from_entries(F.transform("s", lambda x: F.struct(x["dim"], x["s"] / length)))).alias("u"))
        along = first.withColumn("mean", mean).withColumn("along", F.aggregate(F.map_entries("u"), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at("mean", e["key"]), F.lit(0.0))))
        keys = F.array_union(F.map_keys("u"), F.map_keys("mean"))
        value = lambda d: F.coalesce(F.try_element_at("u", d), F.lit(0.0)) - F.col("along") * F.coalesce(F.try_element_at("mean", d), F.lit(0.0))
        rest = along.select("doc_id", "along", F.transform(keys, lambda d: F.struct(d.alias("dim"), value(d).alias("s"))).alias("s"))
        out = rest.select("doc_id", "along", F.when(length > 1e-9, F.map_from_entries(F.transform("s", lambda x: F.struct(x["dim"], x["s"] / length)))).alias("v"))
        return docs.select("doc_id").join(hits, "doc_id", "left").join(out, "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"), "along", "v")
