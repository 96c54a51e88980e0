"""Communities of weighted graphs, and sentence graphs of all documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import tokens, trimmed
from lodestone.operators.storage import discard, written

#: Least similarity of an edge between sentences, least characters of a word.
LEAST_COSINE, LEAST_CHARS = 0.1, 2
#: Sweeps of the power iteration, and after how many a table is written.
POWER, CUT = 24, 4
#: Sentences up to which a text's graph is ranked in its row (134 MB), and terms counted at once there.
ROW_SENTENCES, _TERMS = 4_096, 512


def propagated(edges: DataFrame, sweeps: int = 20) -> DataFrame:
    """node, community of weighted edges (a, b, weight), taken as undirected: label propagation with deterministic ties.

    A node takes the label of the greatest weight around it; its own label
    keeps a tie, else the least one wins.  A digest of the sweep and the node
    says who may move, so a pair cannot swap for ever; the sweeps end when no
    node wants to move.  A node's neighbours meet in a partial sum by label, never in a list.
    """
    both = edges.where("a <> b and weight > 0")
    both = written(both.select("a", "b", "weight").union(both.select(F.col("b"), F.col("a"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "graph")
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct(), "labels")
    for sweep in range(2 * sweeps):
        near = both.join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        own = near.join(labels.select("node", F.col("community").alias("now")), "node")
        best = own.groupBy("node").agg(F.max("now").alias("now"), F.max("w").alias("most"), F.max(F.when(F.col("community") == F.col("now"), F.col("w"))).alias("held"))
        first = own.join(best.select("node", "most"), "node").where("w = most").groupBy("node").agg(F.min("community").alias("first"))
        turn = F.pmod(F.xxhash64(F.lit(sweep), F.col("node").cast("string")), F.lit(2)) == 0
        wants = F.coalesce("held", F.lit(-1.0)) < F.col("most")
        chosen = best.join(first, "node").select("node", F.when(wants & turn, F.col("first")).otherwise(F.col("now")).alias("community"), wants.alias("wants"))
        new = written(chosen, "labels")
        discard(labels)
        labels = new
        if labels.where("wants").isEmpty():
            break
    # a community is known by its least node
    names = labels.groupBy("community").agg(F.min("node").alias("least"))
    return labels.join(names, "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of undirected weighted edges (a, b, weight) under labels (node, community)."""
    kept = edges.where("a <> b and weight > 0")
    sided = kept.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = sided.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), "weight"), F.struct(F.col("cb").alias("c"), "weight"))))
    whole, inside = sided.agg(F.sum("weight"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")))).first()
    square = ends.groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return (inside or 0) / whole - square / (2 * whole) ** 2 if whole else 0.0


def dominant(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, nodes, weight: the one row of the community whose inner edges weigh most (then more nodes, then the least id)."""
    sided = edges.join(labels.select(F.col("node").alias("a"), "community"), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("other")), "b").where("community = other")
    weight = sided.groupBy("community").agg(F.sum("weight").alias("weight"))
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"))
    return size.join(weight, "community", "left").select("community", "nodes", F.coalesce("weight", F.lit(0)).alias("weight")).orderBy(F.desc("weight"), F.desc("nodes"), "community").limit(1)


# --- LexRank --------------------------------------------------------------------------------------------------------------


def _parts() -> Column:
    return F.filter(F.transform(F.split("text", r"(?<=[.!?])[ \t\n\f\r]+|\n+"), lambda s: trimmed(s)), lambda s: s != "")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, place, sentence: a text's parts that end in . ! or ? before white space, or at a line's end; whole texts, trimmed, none empty."""
    return docs.where("text is not null").select("doc_id", F.posexplode(_parts()).alias("place", "sentence"))


def sentence_graph(parts: DataFrame) -> DataFrame:
    """doc_id, a, b, cosine (a < b) of the sentences of each document with a cosine of term counts of LEAST_COSINE or more.

    Sentences meet on the words they share, within their document alone, so no
    sentence is compared with one it shares nothing with.
    """
    counts = parts.select("doc_id", "place", F.explode(tokens(F.col("sentence"))).alias("term")).where(F.char_length("term") >= LEAST_CHARS).groupBy("doc_id", "place", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = written(counts, "sentence-terms")
    length = written(counts.groupBy("doc_id", "place").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("length")), "sentence-lengths")
    other = counts.select("doc_id", "term", F.col("place").alias("b"), F.col("tf").alias("tb"))
    dots = counts.withColumnRenamed("place", "a").join(other, ["doc_id", "term"]).where("a < b").groupBy("doc_id", "a", "b").agg(F.sum(F.col("tf") * F.col("tb")).alias("dot"))
    sided = dots.join(length.select("doc_id", F.col("place").alias("a"), F.col("length").alias("la")), ["doc_id", "a"]).join(length.select("doc_id", F.col("place").alias("b"), F.col("length").alias("lb")), ["doc_id", "b"])
    cosine = F.round(F.col("dot") / F.col("la") / F.col("lb"), 9)
    return sided.withColumn("cosine", cosine).where(F.col("cosine") >= LEAST_COSINE).select("doc_id", "a", "b", "cosine")


def _ranked_in_rounds(parts: DataFrame, n: int, sweeps: int) -> DataFrame:
    """lexrank of parts (doc_id, place, sentence) by one join and one sum a round for all texts, however long they are."""
    graph = sentence_graph(parts)
    loops = parts.select("doc_id", F.col("place").alias("a"), F.col("place").alias("b"), F.lit(1.0).alias("cosine"))
    both = written(graph.select("doc_id", "a", "b", "cosine").union(graph.select("doc_id", F.col("b"), F.col("a"), "cosine")).union(loops), "sentence-graph")
    state = parts.select("doc_id", "place", F.lit(1.0).alias("score"))
    norm = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("doc_id")))
    for sweep in range(sweeps):  # each round reads the last one once, so plans stay short
        given = both.join(state.select("doc_id", F.col("place").alias("a"), "score"), ["doc_id", "a"])
        summed = given.groupBy("doc_id", F.col("b").alias("place")).agg(F.sum(F.col("score") * F.col("cosine")).alias("score"))
        state = summed.select("doc_id", "place", (F.col("score") / norm).alias("score"))
        if sweep % CUT == CUT - 1:
            state = written(state, "scores")
    order = Window.partitionBy("doc_id").orderBy(F.round("score", 6).desc(), "place")
    top = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return parts.join(top.select("doc_id", "place", "score"), ["doc_id", "place"]).select("doc_id", "place", "sentence", "score")


def _central(words: list[list[str]], n: int, sweeps: int) -> list[tuple[int, float]]:
    """(place, score) of the n most central sentences of one text, given as words, in their order."""
    size = np.array([len(w) for w in words])
    at = np.repeat(np.arange(len(words)), size)
    names, term = np.unique(np.array([x for w in words for x in w], dtype=object), return_inverse=True) if len(at) else (np.zeros(0), at)
    near = np.zeros((len(words), len(words)))
    order = np.argsort(term, kind="stable")
    at, term = at[order], term[order]
    for low in range(0, len(names), _TERMS):  # dense counts of some terms at once
        some = slice(*np.searchsorted(term, (low, low + _TERMS)))
        counts = np.zeros((len(words), min(_TERMS, len(names) - low)))
        np.add.at(counts, (at[some], term[some] - low), 1.0)
        near += counts @ counts.T
    length = np.sqrt(near.diagonal())
    for i in range(len(words)):  # a row at a time, so nothing else of this size is held
        if length[i]:
            near[i] = np.round(near[i] / length[i] / np.where(length > 0, length, 1.0), 9)
    near[near < LEAST_COSINE] = 0.0
    np.fill_diagonal(near, 1.0)
    score = np.ones(len(words))
    for _ in range(sweeps):
        score = near @ score
        score /= np.sqrt(score @ score)
    best = np.lexsort((np.arange(len(words)), -np.round(score, 6)))[:n]
    return [(int(i), float(score[i])) for i in sorted(best)]


def _ranked_in_rows(docs: DataFrame, n: int, sweeps: int) -> DataFrame:
    """lexrank of docs (doc_id, parts) whose sentence graphs fit a task: each is made and ranked with its row, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_central(words.as_py(), n, sweeps) for words in b.column("words")]  # a row at a time as Python objects
            top = pa.array([[{"place": i, "score": x} for i, x in row] for row in found], pa.list_(pa.struct([("place", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("parts"), top], ["doc_id", "parts", "top"])

    words = F.transform("parts", lambda s: F.filter(tokens(s), lambda w: F.char_length(w) >= LEAST_CHARS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "parts", words.alias("words")).mapInArrow(run, f"doc_id {kind}, parts array<string>, top array<struct<place: int, score: double>>")
    return out.select("doc_id", "parts", F.inline("top")).select("doc_id", "place", F.get("parts", F.col("place")).alias("sentence"), "score")


def lexrank(docs: DataFrame, n: int = 10, sweeps: int = POWER) -> DataFrame:
    """doc_id, place, sentence, score of the n most central sentences of each document, in their order; all of a document of n or fewer.

    Eigenvector centrality of the sentence graph of each document.  A graph of
    up to ROW_SENTENCES sentences is made and ranked in the document's row;
    those of longer texts are tables, ranked in joint rounds: one join and one
    sum a round, whatever the number of documents.  A sentence keeps its own
    score beside what its neighbours give, which leaves the eigenvector as it
    is and stops graphs of two sides from swinging.  A document without an
    edge has equal scores.
    """
    split = docs.where("text is not null").select("doc_id", _parts().alias("parts")).where(F.size("parts") > 0)
    short = _ranked_in_rows(split.where(F.size("parts") <= ROW_SENTENCES), n, sweeps)
    long_ = written(split.where(F.size("parts") > ROW_SENTENCES).select("doc_id", F.posexplode("parts").alias("place", "sentence")), "sentences")
    return short if long_.isEmpty() else short.union(_ranked_in_rounds(long_, n, sweeps))
