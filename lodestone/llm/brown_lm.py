"""Class-based bigram language model with exchange clustering.

P(w | v) = L * P(class(w) | class(v)) * P(w | class(w)) + (1 - L) * U(w)

with U the additively smoothed unigram.  The CORE most frequent words are
clustered by the exchange algorithm (each word in turn moves to the class that
raises the likelihood of the class bigrams most) on their full bigram counts.
That seeds the classes.  Every further word of the HEAD makes one exchange move
given those, from its counts of neighbouring classes over the whole training
corpus, and then all words of the head, the core among them, are exchanged in
distributed sweeps: each word in parallel against fixed class counts, which are
taken anew after each sweep, until no more than SETTLED of the words move or
PARALLEL sweeps are made.  Rarer words share a residual class, in which absolute
discounting leaves the mass for unknown words; the end of a text is a class of
its own and also stands before the first word.

What is kept in memory has fixed bounds (HEAD words, CLASSES**2 transitions,
CORE**2 bigrams at most); the counts of all words are a distributed table, and
only tokens outside the head are joined with it.  As such a word is rarer than
HEAD others, no key of that join is hot.

Defined results: a null or empty text is one end token; words are runs of
other bytes than ASCII white space, A-Z lower-cased; a null doc_id counts as
the empty string, whose checksum holds it out; repeated rows are trained on
and scored as often as they stand there; without training rows every token has
base probability 1 and so has the model; an empty table gives an empty table;
only doc_id and text are read.  Words are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.textvec import Words, chunked, lists, signed, utf8

CLASSES, CORE, HEAD = 32, 1024, 1 << 18
SWEEPS = 6
#: Most sweeps over the whole head, and the share of moving words that ends them.
PARALLEL, SETTLED = 2, 0.005
#: Share of the class model in the mixture, discount of the residual class, added to a transition.
MIXTURE, DISCOUNT, ADDED = 0.9, 0.75, 0.1
#: Stands for the end of a text.
END = np.uint64(0xE0D0F7E875)
#: Entries of a task's running word counts before they are sent on.
HELD = 1 << 20


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk, an end after each document, and n + 1 offsets."""
    at = w.doc_words + np.arange(len(w.doc_words))
    return np.insert(w.hashes, w.doc_words[1:], END), at


def _previous(kinds: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """The class before each token; the end's before a first one."""
    out = np.empty_like(kinds)
    out[1:] = kinds[:-1]
    out[at[:-1]] = end
    return out


class Lookup:
    """Places of words in the head (a table by hash bits, checked), or -1."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = np.arange(len(hashes), dtype=np.int32)
        self.hashes = hashes

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), -1, np.int32)
        got = self.table[(words >> np.uint64(64 - self.BITS)).astype(np.int64)]
        wrong = np.flatnonzero((got >= 0) & (self.hashes[got] != words))
        if len(wrong):
            place = np.minimum(np.searchsorted(self.sorted, words[wrong]), len(self.sorted) - 1)
            got[wrong] = np.where(self.sorted[place] == words[wrong], self.order[place], -1)
        return got


def _read(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(key) % 10 == 0).alias("held_out"))


def _counts(training: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words = np.concatenate([h for h, _ in held])
            times = np.concatenate([t for _, t in held])
            order = np.argsort(words, kind="stable")
            words, times = words[order], times[order]
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            return words[first], np.add.reduceat(times, first)

        def sent(words: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(times.astype(np.int64))], ["word", "c"])

        for b in batches:
            for w in chunked(utf8(b.column(0))):
                held.append(np.unique(_tokens(w)[0], return_counts=True))
                if sum(len(h) for h, _ in held) > HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged())

    return training.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(training: DataFrame, shape: tuple[int, int], add: object) -> np.ndarray:
    """The sum over all chunks of add(words) -> (rows, columns), counted in a matrix of fixed shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for b in batches:
            for w in chunked(utf8(b.column(0))):
                i, j = add(w)
                total += np.bincount(i.astype(np.int64) * shape[1] + j, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "c"])

    got = training.select("text").mapInArrow(run, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(shape[0] * shape[1], np.int64)
    out[np.asarray(got.column("at"))] = np.asarray(got.column("c"))
    return out.reshape(shape)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words from their bigram counts; words come by falling frequency.

    The likelihood of the class bigram model is, up to a constant, the sum of
    N log N over class bigrams minus that over both margins.
    """
    n = len(bigrams)
    kind = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), kind] = 1
    between = member.T @ bigrams @ member
    to_class, from_class = bigrams @ member, (member.T @ bigrams).T  # word -> class after it, before it
    diagonal = np.diag(bigrams).astype(float)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            old, own = kind[w], diagonal[w]
            out, into = to_class[w].astype(float), from_class[w].astype(float)
            out[old] -= own
            into[old] -= own
            if not out.any() and not into.any():
                continue
            between[old] -= out
            between[:, old] -= into
            between[old, old] -= own
            grown = _xlogx(between + out) - _xlogx(between)  # row c, if w joins c
            grown_in = _xlogx(between.T + into) - _xlogx(between.T)
            gain = grown.sum(axis=1) + grown_in.sum(axis=1)
            d, c = np.diag(between), np.arange(classes)
            gain += _xlogx(d + out[c] + into[c] + own) - _xlogx(d) - grown[c, c] - grown_in[c, c]
            rows, columns = between.sum(axis=1), between.sum(axis=0)
            a, b = out.sum() + own, into.sum() + own
            gain -= _xlogx(rows + a) - _xlogx(rows) + _xlogx(columns + b) - _xlogx(columns)
            new = int(gain.argmax())
            between[new] += out
            between[:, new] += into
            between[new, new] += own
            if new != old:
                kind[w] = new
                moved += 1
                to_class[:, old] -= bigrams[:, w]
                to_class[:, new] += bigrams[:, w]
                from_class[:, old] -= bigrams[w]
                from_class[:, new] += bigrams[w]
        if moved <= n // 200:
            break
    return kind


def _moves(training: DataFrame, lookup: Lookup, kinds: np.ndarray, between: np.ndarray | None, first: int, classes: int) -> np.ndarray:
    """Classes of the head after one exchange move of each word from place first on; kinds has -1 for words without a class.

    between: class bigrams to judge the moves by; those of the moving words themselves if None.
    A word without a neighbour that has a class gets -1.
    """
    C, head = classes, len(kinds)
    lookup_ = training.sparkSession.sparkContext.broadcast((lookup, kinds))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, kinds = lookup_.value
        seen = np.zeros((head, 2 * C), np.int32)
        flat = seen.ravel()
        for b in batches:
            for w in chunked(utf8(b.column(0))):
                words, at = _tokens(w)
                place = find(words)
                k = np.where(place >= 0, kinds[np.maximum(place, 0)], -1)
                before, after = _previous(k, at, -1), np.concatenate((k[1:], [-1]))
                after[at[1:] - 1] = -1
                for side, shift in ((before, 0), (after, C)):
                    use = (place >= first) & (side >= 0)
                    cell, times = np.unique(place[use].astype(np.int64) * (2 * C) + side[use] + shift, return_counts=True)
                    flat[cell] += times.astype(np.int32)
        word, slot = np.nonzero(seen)
        if len(word):
            held, start = np.unique(word, return_index=True)
            cut = np.append(start, len(word))
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), lists(slot.astype(np.int32), cut), lists(seen[word, slot], cut)], ["word", "slots", "times"])

    seen = written(training.select("text").mapInArrow(contexts, "word int, slots array<int>, times array<int>"), "contexts")
    if between is None:

        def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds, total = lookup_.value[1], np.zeros((C + 1) * 2 * C, np.int64)
            for b in batches:
                own = np.repeat(kinds[np.asarray(b.column(0))], np.asarray(b.column(1).value_lengths())).astype(np.int64)
                np.add.at(total, np.where(own < 0, C, own) * 2 * C + np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten()))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "c"])

        got = seen.mapInArrow(by_class, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
        total = np.zeros((C + 1) * 2 * C, np.int64)
        total[np.asarray(got.column("at"))] = np.asarray(got.column("c"))
        between = total.reshape(C + 1, 2 * C)[:C, :C].T  # class before, class of the word
    rows, columns = between.sum(axis=1).astype(float), between.sum(axis=0).astype(float)
    follow = np.log((between + 0.5) / (rows[:, None] + 0.5 * C)) - np.log((columns + 0.5) / (columns.sum() + 0.5 * C))  # by chance 0

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((head, 2 * C), np.int64)
        for b in batches:
            n = np.asarray(b.column(1).value_lengths())
            np.add.at(total, (np.repeat(np.asarray(b.column(0)), n), np.asarray(b.column(1).flatten())), np.asarray(b.column(2).flatten()))
        held = np.flatnonzero(total.any(axis=1))
        best = (total[held, :C] @ follow + total[held, C:] @ follow.T).argmax(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(best.astype(np.int32))], ["word", "class"])

    got = seen.repartition(max(1, head // 8192), "word").mapInArrow(settle, "word int, class int").toArrow()
    out = np.full(head, -1, np.int32)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("class"))
    out[:first] = kinds[:first]
    return out


def scores(docs: DataFrame, classes: int = CLASSES, core: int = CORE, head: int = HEAD, parallel: int = PARALLEL) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    docs = _read(docs)
    spark = docs.sparkSession
    training = docs.where("not held_out").select("text")
    counts = written(_counts(training), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    N, V = total["n"], total["v"]
    D = N + 0.1 * (V + 1)
    top = counts.orderBy(F.col("c").desc(), "word").limit(head).toArrow()
    hashes, c = np.asarray(top.column("word")).view(np.uint64), np.asarray(top.column("c"))
    # the end comes first: it is in the core however few texts there are
    front = np.flatnonzero(hashes == END)
    order = np.concatenate((front, np.flatnonzero(hashes != END)))
    hashes, c = hashes[order], c[order]
    H, K = len(hashes), min(core, len(hashes))
    C, R, E = classes, classes, classes + 1
    lookup = Lookup(hashes)
    sent = spark.sparkContext.broadcast(lookup)

    def pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
        words, at = _tokens(w)
        place = sent.value(words)
        place = np.where((place < 0) | (place >= K), K, place)
        return _previous(place, at, 0), place

    if H > 1:
        bigrams = _summed(training, (K + 1, K + 1), pairs)[1:K, 1:K]  # between words of the core
        kind = exchange(bigrams, C) if K > 1 else np.zeros(0, np.int64)
        member = np.zeros((K - 1, C))
        member[np.arange(K - 1), kind] = 1
        of = np.concatenate(([-1], kind, np.full(H - K, -1))).astype(np.int32)
        of = _moves(training, lookup, of, member.T @ bigrams @ member, K, C)
        for _ in range(parallel):
            new = _moves(training, lookup, of, None, 1, C)
            moved = int((new != of).sum())
            of = new
            if moved <= SETTLED * H:
                break
        of[of < 0] = R  # without a neighbour that has a class
    else:
        of = np.full(H, R, np.int32)
    of[:1] = E
    known = np.append(of, R).astype(np.int32)  # place -1 is the residual class
    sent_of = spark.sparkContext.broadcast(known)

    def moves(w: Words) -> tuple[np.ndarray, np.ndarray]:
        words, at = _tokens(w)
        k = sent_of.value[sent.value(words)]
        return _previous(k, at, E), k

    between = _summed(training, (C + 2, C + 2), moves).astype(float)
    size = between.sum(axis=0)
    follow = (between + ADDED) / (between.sum(axis=1, keepdims=True) + ADDED * (C + 2))
    # in the residual class each word type gives up DISCOUNT of a token to the unknown word
    residual_types = int((of == R).sum()) + V - H
    unigram = (c + 0.1) / D
    emitted = np.where(of == R, c - DISCOUNT, c) / np.maximum(size[of], 1)
    unknown = DISCOUNT * residual_types / max(size[R], 1) if residual_types else 1.0
    model = spark.sparkContext.broadcast((emitted, unigram, follow, np.log10(unigram)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, unigram, follow, base = model.value
        for b in batches:
            for w in chunked(utf8(b.column(1))):
                words, at = _tokens(w)
                place = sent.value(words)
                k = sent_of.value[place]
                before = _previous(k, at, E)
                inside = place >= 0
                p = np.where(inside, place, 0)
                own = np.zeros((3, len(words) + 1))
                if len(base):
                    own[0, 1:] = np.where(inside, base[p], 0)
                    own[1, 1:] = np.where(inside, np.log10(MIXTURE * follow[before, k] * emitted[p] + (1 - MIXTURE) * unigram[p]), 0)
                own[2, 1:] = inside
                base_sum, model_sum, n_known = (np.add.reduceat(x[1:], at[:-1]) for x in own)
                rare = np.flatnonzero(~inside)
                cut = np.searchsorted(rare, at)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.first_row, n), b.column(2).slice(w.first_row, n), pa.array(np.diff(at)), pa.array(n_known.astype(np.int64)), pa.array(base_sum), pa.array(model_sum), lists(signed(words[rare]), cut), lists(before[rare].astype(np.int32), cut)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "before"],
                )

    parts = docs.select("doc_id", "text", "held_out").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, before array<int>")
    parts = written(parts.withColumn("uid", F.monotonically_increasing_id()), "scores")
    # the rare tokens meet their counts
    rare = parts.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "before")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.before").alias("before"))
    tail = counts if H < V else counts.limit(0)
    joined = rare.join(tail, "word", "left")
    c_ = F.coalesce("c", F.lit(0))
    u = (c_ + F.lit(0.1)) / F.lit(float(D))
    step = F.element_at(F.array(*(F.lit(float(x)) for x in follow[:, R])), F.col("before") + 1)
    emission = F.when(c_ > 0, (c_ - F.lit(DISCOUNT)) / F.lit(float(max(size[R], 1)))).otherwise(F.lit(float(unknown)))
    p = F.log10(F.lit(MIXTURE) * step * emission + F.lit(1 - MIXTURE) * u) if N else F.lit(0.0)
    more = joined.groupBy("uid").agg(F.sum((c_ > 0).cast("long")).alias("known2"), F.sum(F.log10(u)).alias("base2"), F.sum(p).alias("score2"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return parts.join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known2")).cast("long").alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), (F.col("base_score") + zero("base2")).alias("base_score"), (F.col("score") + zero("score2")).alias("score")
    )
