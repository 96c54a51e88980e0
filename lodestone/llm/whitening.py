"""Whitening of embeddings by moments merged after Chan et al.

Every partition computes the count, the local mean and the centred scatter of
its vectors, batch by batch; two such states are one by the pairwise formula
of Chan, Golub and LeVeque (1979), in a treeReduce whose inner steps run on
executors.  The driver takes the eigenvectors of one d x d matrix.  A second
pass projects all rows and reduces the covariance of what comes out the same
way, which is held against the identity.

Vectors are integers here: entry c becomes floor(scale * c) + shift.  The
states hold the integers without the shift, as a covariance does not depend
on it, so means are small and sums of integers exact; a row's deviation is
exact as well.

Defined results: a vector that is null or holds a null, NaN or infinite entry
takes no part and has no row; so has a vector without entries.  Vectors of
different dimension are fitted apart, each dimension by its own vectors.
Repeated rows count, and return, as often as they come; a null vec_id stays
null.  A component without variance (one vector, constant entries, fewer
dimensions of spread than components) has whitened null and explained 0, null
if no entry varies at all; the identity is verified over the other components,
error 0 if there are none.  A component's entry of largest size is positive
(the first of equal ones).  Integers beyond 2**62 and deviations beyond 64
bits are held at the nearest such value.  An empty table gives an empty table;
only the two named columns are read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors whose scatter is formed at once.
CHUNK = 4096
#: States that one step of the tree merges.
FAN_IN = 8
#: An eigenvalue at or below this share of the largest one, times the dimension, is no variance.
NO_VARIANCE = 2.0**-50
_LIMIT, _LONG = 1 << 62, (1 << 63) - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """count, local mean and centred scatter of some vectors; sums: of their integers, exact (None for plain doubles)."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int] | None = None

    @classmethod
    def of(cls, x: np.ndarray, whole: bool) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return cls(len(x), mean, centred.T @ centred, exact_sums(x) if whole else None)

    def merge(self, other: Moments) -> Moments:
        """The moments of both sets: the pairwise formula."""
        n = self.n + other.n
        delta = other.mean - self.mean
        sums = None if self.sums is None else [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, self.mean + delta * (other.n / n), self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n), sums)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of integers held as doubles."""
    if np.abs(x).max(initial=0) * len(x) < 2.0**53:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T]


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """States by dimension; neither side is changed."""
    return a | {d: a[d].merge(m) if d in a else m for d, m in b.items()}


def integers(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * c) of their vectors, as doubles) for each dimension, CHUNK rows at most; rows that take no part are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    flat = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            x = flat[begin[part][:, None] + np.arange(d)]
            good = np.isfinite(x).all(axis=1)
            if good.any():
                yield part[good], np.clip(np.floor(scale * x[good]), -_LIMIT, _LIMIT)


def _reduced(vectors: DataFrame, states: Callable[[pa.RecordBatch], Iterator[dict[int, Moments]]]) -> dict[int, Moments]:
    """The states of all partitions, merged in a tree; a partition sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for b in batches:
            for state in states(b):
                own = merged(own, state)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    sent = vectors.mapInArrow(run, "state binary").rdd
    parts = sent.getNumPartitions()
    if parts == 0:
        return {}
    return sent.map(lambda r: pickle.loads(bytes(r.state))).treeReduce(merged, depth=max(2, math.ceil(math.log(parts, FAN_IN))))


@dataclass
class Basis:
    """What whitens the vectors of one dimension: unit components (d x k), their eigenvalues, explained shares and which of them vary."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    live: np.ndarray

    @classmethod
    def of(cls, m: Moments, k: int) -> Basis:
        cov = m.scatter / m.n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        k = min(k, len(values))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[largest, np.arange(k)] < 0, -1.0, 1.0)
        live = values > max(0.0, values[0]) * len(cov) * NO_VARIANCE
        trace = float(np.trace(cov))
        return cls(m.n, m.sums, vectors, np.where(live, values, 0.0), [(float(v) / trace if ok else 0.0) if trace > 0 else None for v, ok in zip(values, live, strict=True)], live)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n as doubles, from the exact n*x - S, and each row's sum of squares of n*x - S."""
        most = self.n * (np.abs(x).max(initial=0) + 1) + max(map(abs, self.sums))
        if most**2 * len(self.sums) < 2.0**62:
            exact = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return exact / self.n, (exact * exact).sum(axis=1).tolist()
        exact = [[self.n * int(v) - s for v, s in zip(row, self.sums, strict=True)] for row in x]
        return np.array([[v / self.n for v in row] for row in exact]), [min(_LONG, sum(v * v for v in row)) for row in exact]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """One column for each component that varies."""
        return centred @ self.components[:, self.live] / np.sqrt(self.values[self.live])


def fit(vectors: DataFrame, k: int, scale: float = 1024.0) -> tuple[dict[int, Basis], dict[int, float]]:
    """Of rows (vec_id, vec): the basis of each dimension, and the largest absolute entry by
    which the covariance of the whitened rows differs from the identity."""
    bases = {d: Basis.of(m, k) for d, m in _reduced(vectors, lambda b: ({x.shape[1]: Moments.of(x, True)} for _, x in integers(b.column(1), scale))).items()}

    def projected(b: pa.RecordBatch) -> Iterator[dict[int, Moments]]:
        for _, x in integers(b.column(1), scale):
            basis = bases[x.shape[1]]
            if basis.live.any():
                yield {x.shape[1]: Moments.of(basis.whitened(basis.centred(x)[0]), False)}

    second = _reduced(vectors, projected) if bases else {}
    return bases, {d: float(np.abs(second[d].scatter / second[d].n - np.eye(len(second[d].mean))).max()) if d in second else 0.0 for d in bases}


def whiten(embeddings: DataFrame, k: int = 8, scale: float = 1024.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error): each vector
    on the first k components by falling eigenvalue, numbered from 1."""
    vectors = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
    bases, errors = fit(vectors, k, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in integers(b.column(1), scale):
                basis, error = bases[x.shape[1]], errors[x.shape[1]]
                centred, deviation = basis.centred(x)
                white = np.full((len(x), len(basis.values)), np.nan)
                white[:, basis.live] = basis.whitened(centred)
                m, c = white.shape
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(rows, c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, basis.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), c))), pa.array(white.ravel(), mask=np.tile(~basis.live, m)), pa.array(basis.explained * m, pa.float64()), pa.array(np.full(m * c, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, SCHEMA)
