"""Quality rules with cross-document line frequency.

Every line is normalised (ASCII lower case, white space collapsed) and hashed;
for each host the distinct documents that hold a line are counted.  Lines held
by more documents than the host's limit are boilerplate and are removed;
documents left with too little are rejected.

Copies of a document, which are the business of deduplication, count once: a
document is known by a hash of the set of its lines, and a host's documents
are counted in the same unit.

Defined results: a null or empty text has no words, fails the base rules and
is not kept; lines without a word are no lines; a null host is a host of its
own; repeated rows each give a row and count once; an empty table gives an
empty table; only doc_id, text and the host column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import if_small, written
from lodestone.llm.textvec import Words, chunked, lists, mix, runs, signed, utf8

#: A line is boilerplate in more documents of its host than both limits.
MIN_DOCUMENTS = 20
SHARE_OF_HOST = 0.05
#: A document is depleted below either of these, after the removal.
MIN_WORDS_LEFT = 50
MIN_SHARE_LEFT = 0.3
#: Shares of a line's rows that are joined apart from each other.
SALTS = 32
#: Lists of lines up to which they may be broadcast.
LISTS = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _base(w: Words) -> dict[str, np.ndarray]:
    n_docs = len(w.doc_words) - 1
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))
    within = lambda x: np.diff(upto(x)[w.doc_bytes])
    in_word = np.zeros(len(w.raw) + 1, np.int8)
    in_word[w.starts] += 1
    in_word[w.ends] -= 1
    in_word = np.cumsum(in_word[:-1]).astype(bool)
    chars = within(in_word & ((w.raw & 0xC0) != 0x80))
    # words covered by a window of three that stands in its document twice or more
    grams, bounds = _same_case(w)
    again = np.zeros(len(w.starts) + 1, bool)
    for i in range(n_docs):
        own = grams[bounds[i] : bounds[i + 1]]
        if len(own) > 1:
            order = np.argsort(own, kind="stable")
            equal = own[order][1:] == own[order][:-1]
            if equal.any():
                at = w.doc_words[i] + np.concatenate((order[1:][equal], order[:-1][equal]))
                for k in range(3):
                    again[at + k] = True
    repeat = np.diff(upto(again[:-1])[w.doc_words])
    return {"n_words": np.diff(w.doc_words), "word_chars": chars, "n_symbols": within(_SYMBOL[w.raw]), "n_repeat_words": repeat}


def _cased(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes that tell upper from lower case, and what they are made of."""
    from lodestone.llm import textvec

    power, inverse = textvec._tables(len(w.raw) + 1)
    sums = np.zeros(len(w.raw) + 1, np.uint64)
    np.cumsum((w.raw.astype(np.uint64) + np.uint64(1)) * power[: len(w.raw)], out=sums[1:])
    return textvec.mix((sums[w.ends] - sums[w.starts]) * inverse[w.starts]), sums, inverse


def _same_case(w: Words) -> tuple[np.ndarray, np.ndarray]:
    return runs(_cased(w)[0], w.doc_words, 3)


def _first_words(w: Words) -> np.ndarray:
    """Where the first word of each line with a word begins."""
    first = np.searchsorted(w.starts, np.unique(np.concatenate((np.flatnonzero(w.raw == 0x0A) + 1, w.doc_bytes))))
    return w.starts[first[:-1][np.diff(first) > 0]]


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines with a word: the document's row, hash of the normalised line, words, and hash of the exact bytes; offsets of documents."""
    from lodestone.llm import textvec

    breaks = np.flatnonzero(w.raw == 0x0A)
    cuts = np.unique(np.concatenate((breaks + 1, w.doc_bytes)))
    first = np.searchsorted(w.starts, cuts)
    held = np.flatnonzero(np.diff(first) > 0)
    begin, end = first[held], first[held + 1]
    # normalised: the sequence of lower-cased words
    power, inverse = textvec._tables(max(len(w.raw), len(w.hashes)) + 1)
    sums = np.zeros(len(w.hashes) + 1, np.uint64)
    np.cumsum(w.hashes * power[: len(w.hashes)], out=sums[1:])
    normal = textvec.mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    # exact: the bytes from one line break, or the document's edge, to the next
    low, high = cuts[held], cuts[held + 1]
    high = np.where(w.raw[high - 1] == 0x0A, high - 1, high)
    doc = np.searchsorted(w.doc_bytes, low, side="right") - 1
    high = np.where(high == w.doc_bytes[doc + 1], high - 1, high)  # without the space after the document
    _, bytes_sums, inverse = _cased(w)
    exact = textvec.mix((bytes_sums[high] - bytes_sums[low]) * inverse[low] + (high - low).astype(np.uint64))
    return doc, normal, end - begin, exact, np.searchsorted(doc, np.arange(len(w.doc_words)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "line_times", "name", "row_key"]
    for b in batches:
        for w in chunked(utf8(b.column(2))):
            base = _base(w)
            _, normal, n_words, exact, at = _lines(w)
            dup, hashes, counts, times, sets, cut = [], [], [], [], [], [0]
            for i in range(len(w.doc_words) - 1):
                s = slice(at[i], at[i + 1])
                dup.append(at[i + 1] - at[i] - len(np.unique(exact[s])))
                h, where, n = np.unique(normal[s], return_index=True, return_counts=True)
                hashes.append(h)
                counts.append(n_words[s][where])
                times.append(n)
                sets.append(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(h)))
                cut.append(cut[-1] + len(h))
            n, cut = len(dup), np.array(cut)
            join = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)]).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(w.first_row, n),
                    b.column(1).slice(w.first_row, n),
                    *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols")),
                    pa.array(np.array(dup, np.int64)),
                    pa.array(base["n_repeat_words"].astype(np.int64)),
                    lists(signed(join(hashes, np.uint64)), cut),
                    lists(join(counts, np.int32), cut),
                    lists(join(times, np.int32), cut),
                    pa.array(signed(mix(np.array(sets, np.uint64)))),
                    b.column(3).slice(w.first_row, n),
                ],
                names,
            )


def _row_key(host: str) -> Column:
    """A hash of what a row is judged by; rows of one key get one verdict, whatever their id is."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col(host).cast("string"), F.col("text").cast("string"))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: base figures, and its distinct lines as parallel
    arrays (hash, words, times it stands there), and the name of their set."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"), _row_key(host).alias("row_key"))
    return read.mapInArrow(_digest, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>, line_times array<int>, name long, row_key long")


def boilerplate(figures: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE_OF_HOST) -> DataFrame:
    """Rows (host, line, documents) of the lines above their host's limit.

    Distinct (host, line, document) rows are counted in two aggregations with
    a partial step each, so a line of a third of all documents is no hot key.
    """
    key = F.xxhash64("host", "line")
    long = figures.select("host", "name", F.explode("lines").alias("line"))
    times = long.groupBy("host", "line", "name").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    hosts = figures.groupBy("host", "name").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    over = times.where(F.col("documents") > min_documents).withColumn("key", key)
    return over.join(hosts, over["host"].eqNullSafe(hosts["host"])).where(F.col("documents") > F.col("host_documents") * F.lit(share)).select(over["host"], "line", "documents", "key")


def _above(figures: DataFrame, min_documents: int, share: float) -> DataFrame:
    """Rows (uid, row_key, line, words) of the lines above their host's limit in each row of figures."""
    # a host's line is found again by a hash of both, which one long holds
    frequent = written(boilerplate(figures, min_documents, share).select("key").distinct(), "boilerplate")
    long = figures.where(F.size("lines") > 0).select("uid", "row_key", "host", F.explode(F.arrays_zip("lines", "line_words", "line_times")).alias("x"))
    long = long.select("uid", "row_key", F.col("x.lines").alias("line"), F.xxhash64("host", "x.lines").alias("key"), (F.col("x.line_words") * F.col("x.line_times")).cast("long").alias("words"))
    small = if_small(frequent)
    if small is frequent:  # too many to broadcast: a frequent line's rows are dealt over SALTS tasks
        salted = frequent.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return long.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("key", "salt")
    return long.join(small, "key").drop("key")


def _verdicts(figures: DataFrame, above: DataFrame, min_words_left: int, min_share_left: float) -> DataFrame:
    removed = above.groupBy("uid").agg(F.sum("words").alias("removed_words"))
    left = F.col("n_words") - F.col("removed_words")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        figures.drop("lines", "line_words", "line_times", "name")
        .join(removed, "uid", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words_left) & (left >= F.col("n_words") * F.lit(min_share_left)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept", "row_key")
    )


def _figures(docs: DataFrame, host: str) -> DataFrame:
    return written(measured(docs, host).withColumn("uid", F.monotonically_increasing_id()), "lines")


def rules(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float = SHARE_OF_HOST, min_words_left: int = MIN_WORDS_LEFT, min_share_left: float = MIN_SHARE_LEFT) -> DataFrame:
    """One row a document: base figures, base_failed, words in removed lines, kept."""
    figures = _figures(docs, host)
    return _verdicts(figures, _above(figures, min_documents, share), min_words_left, min_share_left).drop("row_key")


def _without(docs: DataFrame) -> DataFrame:
    """docs, without their last column _lines, and without the lines of the texts whose hashes it lists; n_chars to match.

    A line goes with its line break; what is left is joined as it was.
    """
    schema = docs.drop("_lines").schema
    columns = schema.names
    text_at = columns.index("text")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.columns[:-1]
            gone = b.column(len(columns))
            hit = np.flatnonzero(np.asarray(gone.is_valid()))
            if len(hit):
                texts = utf8(b.column(text_at).take(pa.array(hit)))
                new = b.column(text_at).to_pylist()
                lists_ = gone.take(pa.array(hit)).to_pylist()
                for w in chunked(texts):
                    doc, normal, _, _, at = _lines(w)
                    breaks = np.flatnonzero(w.raw == 0x0A)
                    # the number of the line in its document: line breaks before its first word, from the document's edge on
                    word = np.searchsorted(breaks, _first_words(w)) - np.searchsorted(breaks, w.doc_bytes[doc])
                    for i in range(len(w.doc_words) - 1):
                        own = slice(at[i], at[i + 1])
                        row = w.first_row + i
                        drop = set(word[own][np.isin(normal[own], np.array(lists_[row], np.int64).view(np.uint64))].tolist())
                        new[hit[row]] = b"\n".join(x for k, x in enumerate(texts[row].split(b"\n")) if k not in drop).decode()
                if chars_at is not None:
                    chars = b.column(chars_at).to_pylist()
                    for k in hit:
                        chars[k] = None if chars[k] is None else len(new[k])
                    out[chars_at] = pa.array(chars, b.column(chars_at).type)
                out[text_at] = pa.array(new, b.column(text_at).type)
            yield pa.RecordBatch.from_arrays(out, columns)

    return docs.select(*columns, "_lines").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float = SHARE_OF_HOST, min_words_left: int = MIN_WORDS_LEFT, min_share_left: float = MIN_SHARE_LEFT) -> DataFrame:
    """docs that the rules keep, their texts without the lines above the limits.

    Rows are judged one by one, those without doc_id too: verdicts and lines
    are taken to the rows by a hash of id, host and text, the rejected ones as a
    list, where that is small enough to broadcast, or by a join.
    """
    figures = _figures(docs, host)
    above = written(_above(figures, min_documents, share), "above")
    verdicts = _verdicts(figures, above, min_words_left, min_share_left)
    rejected = written(verdicts.where("not kept").select(F.col("row_key").alias("_key")).distinct(), "rejected")
    keyed = docs.withColumn("_key", _row_key(host))
    gone = above.select(F.col("row_key").alias("_key"), "line").join(if_small(rejected), "_key", "left_anti").groupBy("_key").agg(F.collect_set("line").alias("_lines"))
    kept = keyed.join(if_small(rejected), "_key", "left_anti").join(if_small(written(gone, "gone"), LISTS), "_key", "left")
    return _without(kept.select(*docs.columns, "_lines"))
