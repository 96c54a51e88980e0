"""Toxicity by a lexicon trie met with Levenshtein automata.

Learning: labelled rows (at most LABELLED, those of least hash, which bounds all
that is learned from them: every term that passes the tests below is kept) give a lexicon
of words and word beginnings that stand in toxic texts far more often than in
others.  The terms form a trie.  The automaton of all strings within a term's
edit distance, intersected with the trie, is made deterministic while it runs:
a state is the set of (trie node, edits left), and each (state, character)
step is kept, so a word costs a dictionary lookup a character and most words
die after two or three.

Scoring: each hit has a kind (whole term, beginning, misspelled) and a context
window.  A window with quotation marks around the hit or words that report
speech tells quotation; other hits nearby tell abuse.  A logistic regression
on these counts, fitted on the labelled rows that did not make the lexicon,
gives the score, so the words that tell quotation are weighed as the labels
say.

Defined results: null and empty texts have no hits and get the score of such
texts; without both labels among the learning rows every score is the share of
toxic ones (0 without rows); of several labels of a document the highest
counts; null labels are ignored; repeated rows each give a row; an empty table
gives an empty table; only doc_id and text, and doc_id and toxic of the labels,
are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

#: Bound of the sample of labelled rows.
LABELLED = 200_000
#: A term's least documents, log odds and share of toxic documents.
MIN_DOCUMENTS, MIN_LOG_ODDS, MIN_PRECISION = 4, 2.5, 0.8
#: Tokens on each side of a hit.
WINDOW = 6
#: Words kept with their verdict by a worker.
KEPT = 300_000
BEGINNINGS = (4, 5, 6, 7)
#: Characters read as letters, and quotation marks.
LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
QUOTES = "\"“”„‟«»‹›‘’"
#: Words that report speech, in the four languages.
REPORTING = frozenset("said says quote quoted called wrote claims sagte schrieb nannte zitat dit écrit appelé cité dijo escribió llamó cita".split())

_WORD = re.compile(r"[^\W\d_]+")
_TRANSLATE = str.maketrans(LETTERS)


def edits_allowed(term: str) -> int:
    """Misspellings of a term: none of short ones, one from five letters, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The deterministic product of the lexicon trie and the terms' automata."""

    def __init__(self, words: Iterable[str], beginnings: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, bool]] = {}  # node -> term, is a beginning
        self.budget: dict[int, int] = {}  # node -> most edits of a term below it
        for term, beginning in [(t, False) for t in words] + [(t, True) for t in beginnings]:
            node, edits = 0, 0 if beginning else edits_allowed(term)
            path = [0]
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
                path.append(node)
            if node not in self.ends or beginning:
                self.ends[node] = (term, beginning)
            for x in path:
                self.budget[x] = max(self.budget.get(x, 0), edits)
        self.states: dict[frozenset[tuple[int, int]], int] = {}
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.steps: list[dict[str, int]] = []
        self.verdicts: list[int | None] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of a term left out; a pair (node, edits) with more edits than another of its node goes."""
        best: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            node, e = todo.pop(0)
            if e > self.budget.get(node, 0) or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset[tuple[int, int]]) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            kinds = [3 if self.ends[n][1] else 1 for n, e in pairs if n in self.ends and e == 0]
            near = [2 for n, e in pairs if n in self.ends and not self.ends[n][1] and 0 < e <= edits_allowed(self.ends[n][0])]
            self.verdicts.append(max(kinds) if kinds else near[0] if near else None)
        return self.states[pairs]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if node in self.ends and self.ends[node][1] and e == 0:
                after.add((node, 0))  # past a beginning anything may come
            if c in self.children[node]:
                after.add((self.children[node][c], e))
            if e < self.budget.get(node, 0):
                after.add((node, e + 1))
                after.update((child, e + 1) for child in self.children[node].values())
        to = self._state(self._closed(after)) if after else -1
        to = -1 if to >= 0 and not self.sets[to] else to
        self.steps[state][c] = to
        return to

    def kind(self, word: str) -> int:
        """0 no hit, 1 a term, 2 a misspelled term, 3 a word with a known beginning."""
        state = self.start
        for c in word:
            state = self.steps[state][c] if c in self.steps[state] else self._step(state, c)
            if state < 0:
                return 0
        return self.verdicts[state] or 0


FEATURES = 11


class Reader:
    """Features of texts; keeps the verdict of each token."""

    def __init__(self, words: list[str], beginnings: list[str]):
        self.matcher = Matcher(words, beginnings)
        self.seen: dict[str, int] = {}

    def _verdict(self, token: str) -> int:
        found = 0
        for form in {*_WORD.findall(token), *_WORD.findall(token.strip("!?.,;:").translate(_TRANSLATE))}:
            if kind := self.matcher.kind(form):
                found = kind if not found or kind == 1 else found
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        for t in set(tokens).difference(self.seen):
            self.seen[t] = self._verdict(t)
        kinds = [self.seen[t] for t in tokens]
        hits = [i for i, k in enumerate(kinds) if k]
        out = [0.0] * FEATURES
        if len(self.seen) > KEPT:
            self.seen.clear()
        if not hits:
            return out
        plain = Counter()
        quoted = crowd = 0
        for i in hits:
            low, high = max(0, i - WINDOW), i + WINDOW + 1
            before, after = tokens[low:i], tokens[i + 1 : high]
            marks = lambda ts: any(c in QUOTES for t in ts for c in (t[0], t[-1]))
            inside = tokens[i][0] in QUOTES and tokens[i][-1] in QUOTES or (marks([*before, tokens[i][:1]]) and marks([tokens[i][-1:], *after]))
            if inside or any(t.strip(":,.") in REPORTING for t in before):
                quoted += 1
            else:
                plain[kinds[i]] += 1
            crowd = max(crowd, sum(1 for k in kinds[low:high] if k))
        share = len(hits) / len(tokens)
        out[:] = [1.0, *(math.log1p(plain[k]) for k in (1, 2, 3)), *(float(plain[k] > 0) for k in (1, 2, 3)), math.log1p(quoted), float(quoted > 0), math.log1p(crowd), math.log(share)]
        return out


def _terms(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= 40}
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def choose_terms(counts: Iterable[tuple[str, int, int]], toxic: int, other: int) -> tuple[list[str], list[str]]:
    """Words and beginnings from (term, toxic documents, other documents); a word under a chosen beginning is left out."""
    good = []
    for term, a, b in counts:
        odds = math.log((a + 0.1) / (toxic + 1)) - math.log((b + 0.1) / (other + 1))
        if a >= MIN_DOCUMENTS and odds >= MIN_LOG_ODDS and a >= MIN_PRECISION * (a + b):
            good.append(term)
    top = set(good)
    beginnings: set[str] = set()
    for t in sorted((t[:-1] for t in top if t.endswith("*")), key=lambda t: (len(t), t)):
        if not any(t[:k] in beginnings for k in range(1, len(t))):
            beginnings.add(t)
    words = sorted(t for t in top if not t.endswith("*"))
    # a beginning that one word alone explains is no beginning
    stems = Counter(b for b in beginnings for w in words if w.startswith(b))
    beginnings = {b for b in beginnings if stems[b] != 1}
    return [w for w in words if not any(w[:k] in beginnings for k in BEGINNINGS)], sorted(beginnings)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression (intercept first), by Newton's method."""
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + eye, x.T @ (y - p) - eye @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(key) % 5 == 0).alias("held_out"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) >= 6).alias("fitting")
    learn = written(docs.join(F.broadcast(known), "doc_id").select("toxic", fold, "text"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in learn.where("not fitting").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = (Counter(), Counter())
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[toxic].update(_terms(text or ""))
            terms = list({**both[0], **both[1]})
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([both[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "toxic", "other"])

    counted = learn.where("not fitting").select("toxic", "text").mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    likely = counted.where((F.col("toxic") >= MIN_DOCUMENTS) & (F.col("toxic") >= F.lit(MIN_PRECISION) * (F.col("toxic") + F.col("other"))))
    rows = [tuple(r) for r in likely.collect()]
    words, beginnings = choose_terms(rows, sizes.get(1, 0), sizes.get(0, 0))
    lexicon = docs.sparkSession.sparkContext.broadcast((words, beginnings))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*lexicon.value)
        for b in batches:
            x = [reader.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    fitting = learn.where("fitting").select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    y = np.asarray(fitting.column("toxic"), float)
    if len(set(y.tolist())) == 2:
        x = np.array(fitting.column("x").to_pylist())
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        weights = fit((x - centre) / scale, y)
    else:
        centre, scale, weights = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        share = float(y.mean()) if len(y) else 0.0
        weights[0] = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    model = docs.sparkSession.sparkContext.broadcast((centre, scale, weights))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*lexicon.value)
        centre, scale, weights = model.value
        for b in batches:
            x = np.array([reader.features(t.as_py()) for t in b.column(1)]).reshape(-1, FEATURES)
            z = weights[0] + ((x - centre) / scale) @ weights[1:]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
