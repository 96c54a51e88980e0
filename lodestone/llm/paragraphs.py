"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are of three kinds:

* Text paragraphs: the lines of a text of SPAN shingles of five words or more,
  and a document of at most WHOLE shingles as a whole.
* Windows, as repeated passages do not keep to line breaks: of every WINDOW
  successive shingles the one of least hash is an anchor, and the SPAN
  shingles from an anchor on are a window.  Two documents that share a run of
  WINDOW + SPAN - 1 shingles (51 words) choose the same anchor in it and so
  have an equal window inside it, wherever the run stands and however its
  lines are broken.
* Fillers: the words that no window holds, between two anchors or at an edge
  of the document, in pieces of SPAN shingles, or of 2 SPAN where one of SPAN
  would be a near copy of its neighbour.

Paragraphs get MinHash signatures; the bands are the fewest that miss a pair
of the threshold with less than 1 - RECALL.  Windows all have SPAN shingles,
so similar ones lack at most one each and are more alike than the threshold:
their bands are fewer.  Fillers have none and meet only as equal sets.
Colliding paragraphs are joined (without all pairs of a group, see links.py),
verified by the exact Jaccard similarity of their shingle sets and clustered;
of each component all but the first occurrence are removed.

Defined results: null and empty texts, and texts without a word, have no
paragraphs; a text of one to four words has one shingle, itself; repeated rows
and equal paragraphs of one document are occurrences of their own; a row with
a null doc_id is an occurrence after all others; an empty table gives an empty
table; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import if_small, written
from lodestone.llm.links import linked_components, verified
from lodestone.llm.textvec import Words, chunked, lists, mix, signed, utf8

SHINGLE = 5
WINDOW, SPAN, WHOLE = 32, 16, 96
PERCENT = 80
RECALL, ROWS = 0.985, 2
#: Kinds of paragraphs.
TEXT, WINDOWED, FILLER = 0, 1, 2
#: Longs of a sketch by kind; text paragraphs may be long, and the kinds never share a band.
SKETCH = {TEXT: 4, WINDOWED: 1}


def bands_for(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that find a pair of that similarity with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def least_alike(size: int, percent: int) -> float:
    """The least similarity of percent / 100 or more that two sets of that size can have."""
    shared = -(-2 * size * percent // (100 + percent))
    return shared / (2 * size - shared)


def _anchors(shingles: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window (the first of equals); of two
    neighbours only the lesser, as their paragraphs would be near copies."""
    views = np.lib.stride_tricks.sliding_window_view(shingles, window)
    at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    close, rises = np.diff(at) == 1, shingles[at[1:]] >= shingles[at[:-1]]
    keep = np.ones(len(at), bool)
    keep[1:] &= ~(close & rises)
    keep[:-1] &= ~(close & ~rises)
    return at[keep]


def _tiles(own: np.ndarray, window: int, span: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First shingles and ends of windows and fillers that hold all words of a document of window + span - 1 shingles or more, windows first, and how many those are.

    A paragraph's words end SHINGLE - 1 after its last shingle begins, so a gap
    up to that needs no paragraph; none begins nearer to another of its length.
    """
    n, near = len(own), SHINGLE - 1
    first = _anchors(own, window)
    first = first[first + span <= n]
    first = first if len(first) else np.zeros(1, np.int64)
    begin, end = [first], [first + span]

    def add(start: int, size: int) -> None:
        begin.append(np.array([start]))
        end.append(np.array([start + size]))

    # between two anchors, from the end of the first one's paragraph on
    left, right = first[:-1] + span, first[1:]
    while len(left := left[(more := right - left > near)]):
        right = right[more]
        begin.append(left)
        end.append(left + span)
        left = left + span
    # before the first
    if 0 < first[0] <= near:
        add(0, 2 * span)
    elif first[0]:
        for at in range(0, int(first[0]) - near, span):
            add(at, span)
    # after the last
    at = int(first[-1]) + span
    while n - at > span + near:
        add(at, span)
        at += span
    if n - at > near:
        add(n - span, span)
    elif n > at:
        add(n - 2 * span, 2 * span)
    return np.concatenate(begin), np.concatenate(end), len(first)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of each line with a word."""
    cuts = np.unique(np.concatenate((np.flatnonzero(w.raw == 0x0A) + 1, w.doc_bytes)))
    first = np.searchsorted(w.starts, cuts)
    held = np.flatnonzero(np.diff(first) > 0)
    begin = first[held]
    return np.searchsorted(w.doc_words, begin, side="right") - 1, begin, first[held + 1]


def _paragraphs(w: Words, window: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a chunk; for each paragraph its document, first shingle, end and kind."""
    shingles, at = w.shingles(SHINGLE)
    size = np.diff(at)
    whole = np.flatnonzero((size > 0) & (size <= max(WHOLE, window + span - 2)))
    docs, begin, finish, kinds = [whole], [at[whole]], [at[whole + 1]], [np.full(len(whole), TEXT)]
    # lines, but for those that are a document already there as a whole
    doc, low, high = _lines(w)
    first = at[doc] + low - w.doc_words[doc]
    held = (high - low >= span + SHINGLE - 1) & ~(np.isin(doc, whole) & (high - low == np.diff(w.doc_words)[doc]))
    docs.append(doc[held])
    begin.append(first[held])
    finish.append((first + high - low - SHINGLE + 1)[held])
    kinds.append(np.full(held.sum(), TEXT))
    for i in np.flatnonzero(size >= window + span - 1):
        low, high, n = _tiles(shingles[at[i] : at[i + 1]], window, span)
        begin.append(low + at[i])
        finish.append(high + at[i])
        docs.append(np.full(len(low), i))
        kinds.append(np.where(np.arange(len(low)) < n, WINDOWED, FILLER))
    doc, first, end, kind = (np.concatenate(x).astype(np.int64) for x in (docs, begin, finish, kinds))
    return shingles, doc, first, end, kind


def _matrix(shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Paragraphs by shingles; shorter ones repeat their last shingle."""
    width = int((end - first).max(initial=1))
    return shingles[np.minimum(first[:, None] + np.arange(width), end[:, None] - 1)]


def _groups(shingles: np.ndarray, first: np.ndarray, end: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paragraphs of at most span shingles together, of at most twice as many, and so on, with their matrix."""
    times = np.ceil(np.log2(np.maximum((end - first) / span, 1)))
    for k in np.unique(times):
        group = np.flatnonzero(times == k)
        yield group, _matrix(shingles, first[group], end[group])


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows, and where a value is not that before it."""
    s = np.sort(m, axis=1)
    return s, np.concatenate((np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]), axis=1)


def _names(m: np.ndarray) -> np.ndarray:
    """A hash of each row's set: equal sets have equal names."""
    s, new = _distinct(m)
    return mix(np.where(new, mix(s ^ np.uint64(0x2545F4914F6CDD1D)), np.uint64(0)).sum(axis=1, dtype=np.uint64))


def _parity(m: np.ndarray, longs: int) -> np.ndarray:
    """Parity sketches of the rows' sets (see links.py): paragraphs by longs."""
    s, new = _distinct(m)
    bit = np.where(new, np.uint64(1) << (s & np.uint64(63)), np.uint64(0))
    at = (s >> np.uint64(6)) % np.uint64(longs)
    return np.stack([np.bitwise_xor.reduce(np.where(at == np.uint64(i), bit, np.uint64(0)), axis=1) for i in range(longs)], axis=1)


def _bands(m: np.ndarray, bands: int, rows: int, kind: int) -> np.ndarray:
    """Paragraphs by band keys, which differ between kinds."""
    keys = np.zeros((len(m), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            seed = np.uint64((2 * (b * rows + r) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
            h = (m ^ (m >> np.uint64(29))) * seed
            keys[:, b] = keys[:, b] * np.uint64(0x100000001B3) + (h ^ (h >> np.uint64(32))).min(axis=1)
        keys[:, b] = mix(keys[:, b] + np.uint64(b + 64 * kind))
    return keys


def _characters(w: Words) -> np.ndarray:
    """Code points before each byte of the buffer."""
    return np.concatenate(([0], np.cumsum((w.raw & 0xC0) != 0x80)))


def paragraphs(docs: DataFrame, percent: int = PERCENT, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """One row a paragraph: doc_id, uid (of its row), text_hash, word and character range, n (shingles of its set), node (hash of the set), sketch and bands; a task gives
    bands for the first of equal paragraphs only, and fillers have none."""
    n_bands = {TEXT: bands_for(percent / 100), WINDOWED: bands_for(least_alike(span, percent)), FILLER: 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for w in chunked(utf8(b.column(1))):
                shingles, doc, first, end, kind = _paragraphs(w, window, span)
                if not len(first):
                    continue
                count = len(first)
                names, n, held = np.zeros(count, np.uint64), np.zeros(count, np.int64), np.zeros(count, np.int64)
                odd, longs = np.zeros((count, max(SKETCH.values())), np.uint64), np.zeros(count, np.int64)
                keys = np.zeros((count, max(n_bands.values())), np.uint64)
                matrices = list(_groups(shingles, first, end, span))
                for group, m in matrices:
                    names[group] = _names(m)
                    n[group] = _distinct(m)[1].sum(axis=1)
                # text paragraphs come first, so an equal window adds no bands
                for i, name in enumerate(names.tolist()):
                    if kind[i] != FILLER and name not in seen:
                        seen.add(name)
                        held[i] = n_bands[kind[i]]
                for group, m in matrices:
                    for k in (TEXT, WINDOWED):
                        own = np.flatnonzero((kind[group] == k) & (held[group] > 0))
                        if len(own):
                            keys[group[own], : n_bands[k]] = _bands(m[own], n_bands[k], ROWS, k)
                            odd[group[own], : SKETCH[k]] = _parity(m[own], SKETCH[k])
                            longs[group[own]] = SKETCH[k]
                _, at = w.shingles(SHINGLE)
                word = first - at[doc]
                words = np.minimum(end - first + SHINGLE - 1, np.diff(w.doc_words)[doc] - word)
                place, chars = w.doc_words[doc] + word, _characters(w)
                base = chars[w.doc_bytes[doc]]
                kept = lambda x, n: lists(signed(x[np.arange(x.shape[1]) < n[:, None]]), np.concatenate(([0], np.cumsum(n))))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).take(pa.array(doc + w.first_row)) for i in (0, 2, 3)),
                        *(pa.array(x.astype(np.int32)) for x in (word, word + words, chars[w.starts[place]] - base, chars[w.ends[place + words - 1]] - base, n)),
                        pa.array(signed(names)),
                        kept(odd, longs),
                        kept(keys, held),
                    ],
                    ["doc_id", "uid", "text_hash", "word_start", "word_end", "char_start", "char_end", "n", "node", "sketch", "bands"],
                )

    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(text).alias("text_hash"))
    return read.mapInArrow(run, "doc_id long, uid long, text_hash long, word_start int, word_end int, char_start int, char_end int, n int, node long, sketch array<long>, bands array<long>")


def _items(docs: DataFrame, window: int, span: int) -> DataFrame:
    """node, part (0, they are short), n and items of every paragraph with bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in chunked(utf8(b.column(0))):
                shingles, _, first, end, kind = _paragraphs(w, window, span)
                first, end = first[kind != FILLER], end[kind != FILLER]
                for _, m in _groups(shingles, first, end, span):
                    values, new = _distinct(m)
                    n = new.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(_names(m))), pa.array(np.zeros(len(m), np.int32)), pa.array(n.astype(np.int32)), lists(signed(values[new]), np.concatenate(([0], np.cumsum(n))))], ["node", "part", "n", "items"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, part int, n int, items array<long>")


def repeated(docs: DataFrame, percent: int = PERCENT, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """One row for each paragraph of a component with two or more occurrences:
    doc_id, its word and character range, component_id, the component's
    occurrences and first doc_id, and whether the paragraph is removed."""
    units = written(paragraphs(docs, percent, window, span), "paragraphs")
    # the paragraph that most tasks hold is the original of its near copies
    bands = units.select(F.explode("bands").alias("block"), "node", "n", "sketch").repartition("block")
    blocks = bands.groupBy("block", "node", "n", "sketch").agg((-F.count(F.lit(1))).alias("rank"))

    def verify(pairs: DataFrame) -> DataFrame:
        """Items are taken again from the documents that hold a node of a pair, known by their texts, as ids may be null."""
        wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
        holders = units.select("node", "text_hash").join(if_small(wanted), "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
        holders = written(holders, "holders")
        sources = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text").join(if_small(holders), "text_hash", "left_semi")
        sets = written(_items(sources, window, span).join(if_small(wanted), "node", "left_semi").dropDuplicates(["node"]), "items")
        return verified(pairs, sets, percent)

    found = written(linked_components(blocks, None, max(SKETCH.values()), percent, verify), "paragraph-components")
    placed = units.drop("bands", "n", "sketch", "text_hash").join(if_small(found), "node", "left").withColumn("component_id", F.coalesce("component", "node")).drop("component", "node")
    here = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.col("word_start").alias("word_start"), F.col("uid").alias("uid"))
    # a table of its own, so that a hot component's rows can be split in the join
    groups = written(placed.groupBy("component_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min(here).alias("first")).where("occurrences > 1"), "groups")
    return placed.join(groups, "component_id").select(
        "doc_id", "word_start", "word_end", "char_start", "char_end", "component_id", "occurrences", F.col("first.doc_id").alias("first_doc_id"), (here > F.col("first")).alias("removed")
    )


def without_repeats(docs: DataFrame, **parameters: int) -> DataFrame:
    """docs (doc_id unique) with the removed paragraphs cut out of the texts.

    Spans are merged natively: sorted by start, what lies between the furthest
    end so far and the next start is kept.  The row travels as one struct, so
    its columns may have any names.
    """
    spans = repeated(docs, **parameters).where("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias("_spans"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    joined = docs.select(F.col("doc_id").cast("long").alias("_id"), row).join(spans, "_id", "left")
    start = F.struct(F.array().cast("array<struct<low:int,high:int>>").alias("gaps"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.when(s["char_start"] > a["at"], F.array_append(a["gaps"], F.struct(a["at"].alias("low"), s["char_start"].alias("high")))).otherwise(a["gaps"]).alias("gaps"), F.greatest(a["at"], s["char_end"]).alias("at"))
    gaps = F.aggregate("_spans", start, step, lambda a: F.array_append(a["gaps"], F.struct(a["at"].alias("low"), F.lit(2**31 - 1).alias("high"))))
    text = F.col("_row.text")
    cut = F.array_join(F.transform(gaps, lambda g: F.substring(text, g["low"] + 1, g["high"] - g["low"])), "")
    return joined.select(F.col("_row").withField("text", F.when(F.col("_spans").isNull(), text).otherwise(cut)).alias("_row")).select("_row.*")
