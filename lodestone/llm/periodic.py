"""Runs of repeated words: block matching with Aho-Corasick over word numbers.

A run is a stretch of consecutive words with smallest period q and length
max(LEAST, 3 q) or more that no neighbour extends.  The words t and t + q agree
along it on 2 q places or more, so an aligned block of L = 2**k <= q words lies
in it whole and comes again q words on.  For each scale L the aligned blocks
of L words are keys of an automaton over integer sequences (pyahocorasick),
searched across the document; an occurrence d words after a block, L <= d < 2 L
(at the least scale 1 <= d < 2 L), is a seed.  Seeds of one distance are
extended both ways word by word, exactly, each stretch once.

What keeps the work near n log n, without losing a run:

* A block of a higher scale is a key only if each of its least blocks comes
  again at a distance of that scale; texts without repeats end at the least one.
* A seed inside a run found before, whose period divides its distance, only
  finds that run again (by the lemma of Fine and Wilf); so does a block with
  all its distances inside a run of a period of at most L.  Distances rise, so
  the run of the smallest period is always found first.
* A key of a higher scale is a sequence of eight numbers, those of its eighths
  (stretches are numbered by doubling), so the failure links of a block that
  repeats itself stay short, and the automaton is smaller at each scale.
* A scale takes its keys from windows of WINDOW words or four blocks, so an
  automaton's memory is bounded by the scale, not by the text; in a text of
  several windows all blocks are keys.

Words are maximal runs of characters other than ASCII white space; they are
numbered within the document, so equal numbers are equal words.

Defined results: a null or empty text, or one without words, has no run and
collapses to the empty text; repeated rows each keep their row; a null doc_id
stays null; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least, and its periods at least.
LEAST, TIMES = 24, 3
#: Words of the blocks at the least scale: a run of LEAST words and a period under twice that holds an aligned block, and the block a period on.
BLOCK = 8
#: Numbers up to which one symbol stands for one.
DIGITS = 1024
#: Words whose blocks share an automaton at most.
WINDOW = 1 << 20

Run = tuple[int, int, int]


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, by first occurrence."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class _Found:
    """Runs by period, in order of their starts."""

    def __init__(self) -> None:
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def add(self, period: int, runs: list[tuple[int, int]]) -> None:
        if runs:
            self.by_period[period] = sorted(runs)

    def holds(self, begin: np.ndarray, end: np.ndarray, periods: list[int]) -> np.ndarray:
        """Which [begin, end) lie inside a run of one of the periods."""
        out = np.zeros(len(begin), bool)
        for p in periods:
            starts, ends = np.array(self.by_period[p], np.int64).T
            last = np.searchsorted(starts, begin, "right") - 1  # runs of one period overlap by less than it: ends rise with starts
            out |= (last >= 0) & (ends[last] >= end)
        return out

    def divisors(self, d: int) -> list[int]:
        return [p for p in self.by_period if p < d and d % p == 0]


class _Names:
    """Equal numbers for equal stretches of m words, m a power of two, at every place."""

    def __init__(self, w: np.ndarray):
        self.m, self.at = 1, w

    def grow(self, m: int) -> None:
        """Double the stretches up to m words: a stretch is the pair of its halves."""
        while self.m < m:
            pair = self.at[: -self.m] * (int(self.at.max()) + 1) + self.at[self.m :]
            self.at = np.unique(pair, return_inverse=True)[1]
            self.m *= 2

    def symbols(self) -> np.ndarray:
        """A row for each place: its number, or two digits of it where there are many (nodes of an automaton look through their children)."""
        most = int(self.at.max()) + 1
        if most <= DIGITS:
            return self.at[:, None]
        base = math.isqrt(most) + 1
        return np.stack((self.at // base + base, self.at % base), axis=1)


def _occurrences(names: _Names, blocks: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks at the given places by an automaton, as BLOCK stretches of names: the number of each
    block, and starts and numbers of all occurrences up to reach words after the first and last of them."""
    symbols, m = names.symbols(), size // BLOCK
    digits = symbols.shape[1]
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    known: dict[tuple[int, ...], int] = {}
    own = np.empty(len(blocks), np.int64)
    for i, key in enumerate(map(tuple, symbols[blocks[:, None] + m * np.arange(BLOCK)].reshape(len(blocks), -1).tolist())):
        number = known.get(key)
        if number is None:
            number = known[key] = len(known)
            auto.add_word(key, number)
        own[i] = number
    auto.make_automaton()
    first, last = int(blocks[0]), int(blocks[-1]) + reach + size - m + 1
    out = []
    for phase in range(first, min(first + m, last, len(symbols))):  # places m apart make one text
        hits = np.fromiter((x for pair in auto.iter(tuple(symbols[phase:last:m].ravel().tolist())) for x in pair), np.int64).reshape(-1, 2)
        out.append(np.stack((phase + ((hits[:, 0] + 1) // digits - BLOCK) * m, hits[:, 1])))
    at, number = np.concatenate(out, axis=1)
    return own, at, number


def _seeds(names: _Names, n: int, blocks: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """Seeds: places of blocks and distances, least <= distance < 2 size.

    If one window holds all blocks, also their numbers and the sorted codes
    (number times twice the length, plus place) of all occurrences.
    """
    step = max(WINDOW, 4 * size)
    places, distances, marks = [], [], None
    for low in range(int(blocks[0]) // step * step, int(blocks[-1]) + 1, step):
        part = blocks[np.searchsorted(blocks, low) : np.searchsorted(blocks, low + step)]
        if not len(part):
            continue
        own, at, number = _occurrences(names, part, size, 2 * size - 1)
        number_at = np.full(step // size, -1, np.int64)
        number_at[(part - low) // size] = own
        for back in (0, size)[least == size :]:
            # the one aligned place that lies back to back + size - 1 words before the occurrence
            t = (at - back) // size * size
            ok = (t >= low) & (t < low + step) & (at - t >= least)
            ok[ok] = number_at[(t[ok] - low) // size] == number[ok]
            places.append(t[ok])
            distances.append((at - t)[ok])
        if len(part) == len(blocks):
            marks = own, np.sort(number * (2 * n) + at)
    return np.concatenate(places), np.concatenate(distances), marks


def _candidates(n: int, size: int, found: _Found, marks: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Places of the aligned blocks of a higher scale that can come again at one of its distances."""
    places = np.arange(n // size, dtype=np.int64) * size
    if marks is not None:
        own, codes = marks
        t = np.arange(n // size * (size // BLOCK), dtype=np.int64) * BLOCK
        low = own[: len(t)] * (2 * n) + t + size
        after = np.searchsorted(codes, low)
        again = codes[np.minimum(after, len(codes) - 1)] - low
        places = places[((again >= 0) & (again < size)).reshape(-1, size // BLOCK).all(axis=1)]
    return places[~found.holds(places, places + 3 * size, [p for p in found.by_period if p <= size])]


def _reach(w: np.ndarray, t: int, d: int, sign: int) -> int:
    """How many places from t on (sign 1; -1: before t) agree with those d on."""
    n, got, size = len(w), 0, 32
    most = n - d - t if sign > 0 else t
    while got < most:
        k = min(size, most - got)
        a = t + got if sign > 0 else t - got - k
        differ = np.flatnonzero(w[a : a + k] != w[a + d : a + d + k])
        if len(differ):
            return got + int(differ[0] if sign > 0 else k - 1 - differ[-1])
        got, size = got + k, size * 2
    return got


def _extend(w: np.ndarray, places: np.ndarray, distances: np.ndarray, found: _Found) -> None:
    """Runs of the seeds, by rising distance."""
    order = np.lexsort((places, distances))
    places, distances = places[order], distances[order]
    for begin, end in zip(*_groups(distances), strict=True):
        d, own = int(distances[begin]), places[begin:end]
        smaller = found.divisors(d)
        own = own[~found.holds(own, own + d, smaller)]
        runs, over = [], -1
        for t in own.tolist():
            if t < over:
                continue
            start, over = t - _reach(w, t, d, -1), t + _reach(w, t, d, 1)
            if over - start + d >= max(LEAST, TIMES * d):
                runs.append((start, over + d))
        if runs and smaller:
            inside = found.holds(np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), smaller)
            runs = [r for r, no in zip(runs, inside, strict=True) if not no]
        found.add(d, runs)


def _groups(x: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(x)) + 1
    return [0, *edge.tolist()] if len(x) else [], [*edge.tolist(), len(x)] if len(x) else []


def runs_of(w: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    n, found = len(w), _Found()
    if n < LEAST:
        return []
    blocks = np.arange(n // BLOCK, dtype=np.int64) * BLOCK
    names = _Names(w)
    *seeds, marks = _seeds(names, n, blocks, BLOCK, 1)
    _extend(w, *seeds, found)
    size = 2 * BLOCK
    while TIMES * size <= n and (marks is None or len(marks[1]) > marks[0].max() + 1):  # else no block comes again
        candidates = _candidates(n, size, found, marks)
        if len(candidates):
            names.grow(size // BLOCK)
            _extend(w, *_seeds(names, n, candidates, size, size)[:2], found)
        size *= 2
    return sorted((s, e - s, p) for p, runs in found.by_period.items() for s, e in runs)


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


# --- tables -------------------------------------------------------------------------------------------------------------

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def found(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """Rows (doc_id, runs array of (start, length, period), collapsed): the runs of every text, and its words without the repeats, joined by spaces.

    prepare: changes the words of a document before they are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                every, left = [], []
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = (text or b"").split()  # at ASCII white space
                    if prepare:
                        words = prepare(doc_id, words)
                    runs = runs_of(numbers(words))
                    every.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    left.append(b" ".join(words if not runs else [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(every, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def rotated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the documents whose crc32 ends in 0 become periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def digests(table: DataFrame) -> DataFrame:
    """Of found(): doc_id, n_runs, the run of the greatest length / period, digests of the runs and of the words left."""
    best = F.expr("""array_sort(runs, (a, b) -> CASE WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1)
                     WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) WHEN a.period <> b.period THEN IF(a.period < b.period, -1, 1) ELSE 0 END)[0]""")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = table.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
