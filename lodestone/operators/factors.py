"""Factorisation of sparse tables: truncated SVD and non-negative factors.

A matrix is a table (row, col, value) of its entries.  A factor is a table
(item, v) with one short array for each item.  Products with a factor are
joins and sums; k x k products of a factor with itself, and for the SVD its rows
of at most HEAD frequent columns, reach the driver and go out again with the
tasks that use them.  Every sweep is written, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import bucketed, discard, if_small, written

#: Floor of a seeded start and guard of a quotient: fixed values.
FLOOR, EPSILON = 1e-3, 1e-9
#: Columns beside the asked ones that a subspace carries, and its sweeps.
SPARE, SWEEPS = 6, 6


def seeded(items: DataFrame, k: int, seed: str = "", *more: str) -> DataFrame:
    """item, v: k numbers in [0, 1) from a digest of seed, item and place; more: columns that stay."""
    draw = lambda j: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{j}:"), F.col("item").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return items.select("item", *more, F.array(*(draw(j) for j in range(k))).alias("v"))


#: Items up to which a factor may be broadcast (20 MB at 128 columns).
SMALL = 20_000


def product(matrix: DataFrame, factor: DataFrame, k: int, transposed: bool = False, small: bool | None = None) -> DataFrame:
    """item, v of the matrix times a factor over its columns (transposed: of its transpose times one over its rows).

    small: whether the factor has SMALL items at most; counted if not known.
    """
    kept, met = ("col", "row") if transposed else ("row", "col")
    side = factor.select(F.col("item").alias(met), "v")
    side = if_small(side, SMALL) if small is None else F.broadcast(side) if small else side
    sums = matrix.join(side, met).groupBy(F.col(kept).alias("item")).agg(*(F.sum(F.col("value") * F.col("v")[j]).alias(f"s{j}") for j in range(k)))
    return sums.select("item", F.array(*(f"s{j}" for j in range(k))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def mapped(factor: DataFrame, f: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """item, v = f(matrices of the columns), rows of a batch at once; small matrices in f travel with it, so no plan is compiled anew for their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(*(_matrix(b.column(i + 1)) for i in range(b.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))], ["item", "v"])

    kind = factor.schema["item"].dataType.simpleString()
    return factor.select("item", *(columns or ("v",))).mapInArrow(run, f"item {kind}, v array<double>")


def gram(factor: DataFrame, k: int) -> np.ndarray:
    """The k x k products of a factor's columns; a partition sends k x k sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(0))
                own += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(own.ravel())], ["cell", "x"])

    out = np.zeros(k * k)
    for r in factor.select("v").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r.cell] = r.x
    return (out.reshape(k, k) + out.reshape(k, k).T) / 2


def times(factor: DataFrame, m: np.ndarray) -> DataFrame:
    """item, v times a small matrix."""
    return mapped(factor, lambda v: v @ m)


# --- truncated SVD ---------------------------------------------------------------------------------------------------------


@dataclass
class Truncated:
    """left and right: item, v of the rows and columns; values: non-increasing; each left column's entry of largest size is positive; head: v of the head columns."""

    left: DataFrame
    values: list[float]
    right: DataFrame
    head: np.ndarray


def _basis(g: np.ndarray) -> np.ndarray:
    """What makes the columns of a factor with products g orthonormal; directions without length go."""
    values, axes = np.linalg.eigh(g)
    live = values > max(values.max(initial=0), 0) * 1e-14 * len(g)
    return (axes[:, live] / np.sqrt(values[live]))[:, ::-1]


@dataclass
class Matrix:
    """A sparse table in parts: what its HEAD most frequent columns hold goes over once a product with no shuffle, the rest by joins.

    rows: row, ids, values: each row's entries in the head columns (places in
    names), times the column's weight; every row of the table is there, once.
    tail: row, col, value: entries of columns with two or more that are not of the head.
    lone: row, col, value: entries of columns with just one, not of the head.
    cols: item, df: all columns and how many entries they have; head ones have least or more.
    """

    rows: DataFrame
    tail: DataFrame
    lone: DataFrame
    cols: DataFrame
    least: int
    names: pa.Array
    weights: np.ndarray


#: Columns of the head at most: their part of a factor (117 MB at 14 columns) is what a task holds and the driver gathers at once.
HEAD = 1 << 20
#: Buckets of a matrix's rows: a bucket's task sends one sum a head column, so their number doesn't follow the input.
BUCKETS = 16


def head_of(cols: DataFrame, most: int = HEAD) -> tuple[int, pa.Table]:
    """The least df whose columns and more frequent ones are `most` at most, and those columns (rows of cols) by item."""
    least, held = 1 << 62, 0
    for r in sorted(cols.groupBy("df").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.df):
        if (held := held + r.n) > most:
            break
        least = r.df
    return least, cols.where(F.col("df") >= least).toArrow().sort_by("item")


def matrix_of(entries: DataFrame, most: int = HEAD) -> Matrix:
    """Of a table (row, col, value) without zeros, written."""
    cols = written(entries.groupBy(F.col("col").alias("item")).agg(F.count(F.lit(1)).alias("df")), "cols")
    least, head = head_of(cols, most)
    names = head.column("item").combine_chunks()
    ids = entries.sparkSession.createDataFrame(pa.table({"col": names, "id": pa.array(range(len(names)), pa.int32())}))
    named = entries.join(F.broadcast(ids), "col", "left") if len(names) else entries.withColumn("id", F.lit(None).cast("int"))
    cell = F.when(F.col("id").isNotNull(), F.struct("id", "value"))
    rows = named.groupBy("row").agg(F.collect_list(cell).alias("c")).select("row", F.col("c.id").alias("ids"), F.col("c.value").alias("values"))
    rest = written(entries.join(cols.where(F.col("df") < least).select(F.col("item").alias("col"), "df"), "col"), "rest")
    return Matrix(bucketed(rows, "row", BUCKETS), rest.where("df > 1").drop("df"), rest.where("df = 1").drop("df"), cols, least, names, np.ones(len(names)))


def added(rows: DataFrame, by: str, k: int) -> DataFrame:
    """item, v: sums of v by a column."""
    sums = rows.groupBy(F.col(by).alias("item")).agg(*(F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(k)))
    return sums.select("item", F.array(*(f"s{j}" for j in range(k))).alias("v"))


def over(m: Matrix, head: np.ndarray, side: DataFrame) -> DataFrame:
    """item, v of every row: the matrix times a factor whose head part is given, with what other columns bring a row in side (item, v)."""
    k, sent = head.shape[1], side.sparkSession.sparkContext.broadcast(head * m.weights[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, at, x = _cells(b)
                left, some = np.zeros((b.num_rows, k)), np.asarray(b.column(3).is_valid())
                left[some] = np.asarray(b.column(3).flatten()).reshape(-1, k)
                for j in range(k):
                    left[:, j] += np.bincount(row, x * sent.value[at, j], b.num_rows)
                yield _factor(b.column(0), left)

    met = m.rows.join(side.select(F.col("item").alias("row"), "v"), "row", "left").select("row", "ids", "values", "v")
    return met.mapInArrow(run, f"item {m.rows.schema['row'].dataType.simpleString()}, v array<double>")


def back(m: Matrix, left: DataFrame, k: int) -> DataFrame:
    """item (the place of a head column), v of the transposed matrix times a factor over its rows; a task sends one sum a column."""
    places = len(m.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((places, k))
        for b in batches:
            if b.num_rows:
                row, at, x = _cells(b)
                held, own = np.unique(at, return_inverse=True)
                v = _matrix(b.column(3))
                for j in range(k):
                    sums[held, j] += np.bincount(own, x * v[row, j], len(held))
        held = np.flatnonzero(sums.any(axis=1))
        for s in range(0, len(held), 65_536):
            own = held[s : s + 65_536]
            yield _factor(pa.array(own.astype(np.int32)), sums[own])

    met = m.rows.join(left.select(F.col("item").alias("row"), "v"), "row").select("row", "ids", "values", "v")
    return added(met.mapInArrow(run, "item int, v array<double>"), "item", k)


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of the entries of rows (row, ids, values)."""
    return np.repeat(np.arange(b.num_rows), np.asarray(b.column(1).value_lengths())), np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten())


def _factor(items: pa.Array, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([items, pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))], ["item", "v"])


def truncated_svd(matrix: DataFrame | Matrix, rank: int, sweeps: int = SWEEPS, seed: str = "", head: int = HEAD) -> Truncated:
    """The rank greatest singular values of a table (row, col, value) and their vectors, by subspace iteration from a seeded start.

    An empty matrix, or one of zeros, has no values; a matrix of a smaller rank has as many as its rank.
    A sweep goes over the head columns' entries once; those of the tail meet
    their factor by joins; a column with one entry is its row's: it needs no
    factor of its own, as its part of the next one is its value times the row's.
    """
    if isinstance(matrix, DataFrame):
        matrix = matrix_of(written(matrix.where("value <> 0").select("row", "col", F.col("value").cast("double").alias("value")), "matrix"), head)
    m, k = matrix, rank + SPARE
    draw = lambda cols: seeded(cols, k, seed).select("item", F.transform("v", lambda x: x - 0.5).alias("v"))
    first = draw(m.cols.where(F.col("df") >= m.least)).toArrow().sort_by("item")
    top = np.asarray(first.column("v").combine_chunks().flatten()).reshape(-1, k)
    rest = written(draw(m.tail.select(F.col("col").alias("item")).distinct()), "right")
    started = seeded(m.lone.select(F.col("col").alias("item"), "row", "value"), k, seed, "row", "value").select("row", F.transform("v", lambda x: F.col("value") * (x - 0.5)).alias("v"))
    alone = written(added(started, "row", k), "alone")
    energy = written(m.lone.groupBy("row").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), "energy")
    before, change = None, None

    def rows_of() -> DataFrame:
        own = alone if before is None else mapped(before.join(energy.withColumnRenamed("row", "item"), "item").select("item", "v", F.array("energy").alias("energy")), lambda v, e: e * (v @ change), "v", "energy")
        tail = m.tail.join(rest.withColumnRenamed("item", "col"), "col").select(F.col("row").alias("item"), F.transform("v", lambda x: F.col("value") * x).alias("v"))
        return written(over(m, top, added(tail.unionByName(own), "item", k)), "left")

    for _ in range(sweeps):
        left = rows_of()
        q = _basis(gram(left, k))
        if not q.shape[1]:
            break
        new = written(added(m.tail.join(left.withColumnRenamed("item", "row"), "row").select("col", F.transform("v", lambda x: F.col("value") * x).alias("v")), "col", k), "new")
        found = back(m, left, k).toArrow()
        up = np.zeros((len(m.names), k))
        if found.num_rows:
            up[np.asarray(found.column("item"))] = np.asarray(found.column("v").combine_chunks().flatten()).reshape(-1, k) * m.weights[np.asarray(found.column("item")), None]
        of_lone = left.join(energy.withColumnRenamed("row", "item"), "item").select("item", F.transform("v", lambda x: F.sqrt("energy") * x).alias("v"))
        p = _basis(q.T @ (up.T @ up + gram(new, k) + gram(of_lone, k)) @ q)
        discard(rest, *([] if before is None else [before]))
        before, change, top = left, q @ p, up @ q @ p
        rest = written(times(new, change), "right")
        discard(new)
        k = change.shape[1]
    left = rows_of()
    values, axes = np.linalg.eigh(gram(left, k))
    order = [i for i in np.argsort(-values)[:rank].tolist() if values[i] > max(values.max(), 0) * 1e-14]
    sigma, axes = np.sqrt(values[order]), axes[:, order]
    if not order:
        none = m.rows.select(F.col("row").alias("item"), F.array().cast("array<double>").alias("v")).where("false")
        return Truncated(none, [], m.cols.select("item", F.array().cast("array<double>").alias("v")).where("false"), np.zeros((len(m.names), 0)))
    left = written(times(left, axes / sigma).where(F.exists("v", lambda x: x != 0)), "left")
    largest = left.agg(*(F.max_by(F.col("v")[j], F.struct(F.round(F.abs(F.col("v")[j]), 12), F.col("item"))).alias(f"m{j}") for j in range(len(order)))).first()
    sign = np.array([-1.0 if (x or 0) < 0 else 1.0 for x in largest])
    turn = axes * sign
    of_row = before.select(F.col("item").alias("row"), "v")
    lone = mapped(m.lone.join(of_row, "row").select(F.col("col").alias("item"), "v", F.array("value").alias("value")), lambda v, x: x * (v @ change @ turn), "v", "value")
    right = _named(m, back(m, before, change.shape[0]), change @ turn).unionByName(times(rest, turn)).unionByName(lone)
    return Truncated(written(times(left, np.diag(sign)), "left"), sigma.tolist(), right, top @ turn)


def _named(m: Matrix, sums: DataFrame, change: np.ndarray) -> DataFrame:
    """item, v of the head columns from sums by their places."""
    sent = sums.sparkSession.sparkContext.broadcast((m.names, m.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = (_matrix(b.column(1)) * sent.value[1][np.asarray(b.column(0)), None]) @ change
                yield _factor(sent.value[0].take(b.column(0)), v)

    return sums.mapInArrow(run, f"item {m.cols.schema['item'].dataType.simpleString()}, v array<double>")


# --- non-negative factors --------------------------------------------------------------------------------------------------


@dataclass
class Factors:
    """rows and cols: item, v; losses: the squared Frobenius distance after each sweep."""

    rows: DataFrame
    cols: DataFrame
    losses: list[float]


def _multiplied(old: DataFrame, up: DataFrame, g: np.ndarray) -> DataFrame:
    """old * up / (old g + epsilon); every item of a factor has an entry, so it has products."""
    joined = old.join(up.select("item", F.col("v").alias("up")), "item")
    return mapped(joined, lambda v, up: v * up / (v @ g + EPSILON), "v", "up")


def _solved(old: DataFrame, up: DataFrame, g: np.ndarray) -> DataFrame:
    """The least squares factor, negative entries set to 0."""
    inverse = np.linalg.pinv(g)
    return mapped(up, lambda up: np.maximum(up @ inverse, 0.0))


def non_negative(matrix: DataFrame, k: int, sweeps: int = 20, seed: str = "", tolerance: float = 1e-6, method: str = "multiply") -> Factors:
    """Factors of a non-negative table (row, col, value; absent entries are 0) by multiplicative updates (Lee and Seung, 2001) or, method "solve", alternating least squares.

    The start is seeded by item, at FLOOR at least.  A sweep ends the fit when
    it changes the loss by less than tolerance.  The loss comes from products
    that the update needs anyway: |O|^2 - 2 tr(W'OH') + tr(W'W HH').
    """
    change = {"multiply": _multiplied, "solve": _solved}[method]
    matrix = written(matrix.groupBy("row", "col").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value > 0"), "matrix")
    start = lambda side: written(seeded(matrix.select(F.col(side).alias("item")).distinct(), k, f"{seed}{side}").select("item", F.transform("v", lambda x: F.greatest(x, F.lit(FLOOR))).alias("v")), side)
    w, h = start("row"), start("col")
    few = w.count() <= SMALL, h.count() <= SMALL
    whole = matrix.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    losses: list[float] = []
    left = gram(w, k)
    for _ in range(sweeps if whole else 0):
        old, h = h, written(change(h, product(matrix, w, k, True, few[0]), left), "col")
        discard(old)
        right = gram(h, k)
        up = written(product(matrix, h, k, False, few[1]), "up")
        old, w = w, written(change(w, up, right), "row")
        both = w.join(up.select("item", F.col("v").alias("up")), "item").agg(sum((F.sum(F.col("v")[j] * F.col("up")[j]) for j in range(k)), F.lit(0.0))).first()[0] or 0.0
        discard(old, up)
        left = gram(w, k)
        losses.append(float(whole - 2 * both + (left * right).sum()))
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) < tolerance:
            break
    return Factors(w, h, losses)


def themes(pairs: DataFrame, k: int, sweeps: int = 20, seed: str = "") -> DataFrame:
    """item, loadings, theme of the labels of weighted pairs (a, b, weight), taken as symmetric; theme: the greatest loading's place, the first of equal ones."""
    every = pairs.select(F.col("a").alias("row"), F.col("b").alias("col"), F.col("weight").alias("value"))
    both = every.unionByName(every.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    found = non_negative(both, k, sweeps, seed).rows
    return found.select("item", F.col("v").alias("loadings"), (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("theme"))


