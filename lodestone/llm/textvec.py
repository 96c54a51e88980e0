"""Word hashing over whole Arrow text columns with numpy.

A chunk of documents is joined into one byte buffer; words (maximal runs of
bytes other than ASCII white space) are found and hashed for the whole chunk
at once, so no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64))) for b in (_BASE, _INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some documents: raw and lower-cased bytes (one space after
    each document), word bounds and hashes, and each document's word range."""

    raw: np.ndarray
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc_bytes: np.ndarray  # n + 1 offsets into the buffer
    doc_words: np.ndarray  # n + 1 offsets into the words
    first_row: int

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows of each document, and n + 1 offsets.

        A document of 1 to k-1 words has one window, its whole sequence; one
        without words has none.
        """
        n = np.diff(self.doc_words)
        out, bounds = runs(self.hashes, self.doc_words, k)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = [fold(self.hashes[self.doc_words[i] : self.doc_words[i + 1]]) for i in short]
            out = np.insert(out, bounds[short], np.array(whole, np.uint64))
            extra = np.zeros(len(n) + 1, np.int64)
            extra[short + 1] = 1
            bounds = bounds + np.cumsum(extra)
        return out, bounds


def fold(hashes: np.ndarray) -> np.uint64:
    """A hash of a sequence of hashes."""
    p = _tables(len(hashes))[0][: len(hashes)]
    return mix(np.array([(hashes * p).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]


def runs(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k successive values inside each group of offsets."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if bounds[-1] == 0:
        return np.zeros(0, np.uint64), bounds
    x = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        x += hashes[i : len(hashes) - k + 1 + i] * _tables(k)[0][i + 1]
    first = np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return mix(x[first]), bounds


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes."""
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words_of(texts: list[bytes], first_row: int = 0) -> Words:
    """texts: UTF-8; only A-Z are lower-cased."""
    joined = b" ".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    low = np.frombuffer(joined.lower(), np.uint8)  # bytes.lower() knows ASCII alone
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate((np.ones(1, np.int8), space.view(np.int8), np.ones(1, np.int8)))))
    starts, ends = edge[0::2], edge[1::2]
    hashes = span_hashes(low, starts, ends)
    doc_bytes = np.concatenate(([0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))))
    return Words(raw, low, starts, ends, hashes, doc_bytes, np.searchsorted(starts, doc_bytes), first_row)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as bytes, null as none."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def chunked(texts: list[bytes]) -> Iterator[Words]:
    """Words of successive groups of texts of about CHUNK_BYTES."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > CHUNK_BYTES:
            yield words_of(texts[begin:i], begin)
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield words_of(texts[begin:], begin)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list column of values cut at offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
