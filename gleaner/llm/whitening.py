"""Whitening of vectors by their principal components.

Vectors are whole numbers here (``quantized`` makes them of fractions), so sums are exact and do not
depend on how rows are dealt. The scatter is taken about the mean's floor: tasks add outer products of
blocks that are short enough for doubles to hold every sum exactly, Spark adds the tasks' numbers as
decimals, and the driver, which holds one number per pair of dimensions, corrects for the mean's
fraction in whole numbers and rounds once.

Pivoted Cholesky of that matrix gives a triangular factor and the rank; one-sided Jacobi rotates the
factor's columns until all are orthogonal. Their squared norms are the eigenvalues, the normalised
columns the components.

Defined results: vectors that are null, or hold null or non-finite entries, or entries too large for a
64-bit number once quantized, are dropped; a vector of another length than most (the smaller one on a
draw) is dropped, too. Repeated vectors count once in the fit and are all whitened. Where the vectors
span fewer dimensions than components are asked for, there are fewer; one distinct vector, or none, has
no component, and gives no rows. Other columns come along, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from gleaner.llm.shared import require, ship, shipped, written

COMPONENTS = 16
EXACT = 1 << 53  # doubles hold every whole number up to here
LARGEST = float(1 << 61)
BLOCK_ROWS = 4096

RESULT = ("component", "deviation", "whitened")


def _length_of(vectors: DataFrame, column: str) -> int | None:
    """The length that most vectors have, the smaller one on a draw."""
    sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count()
    return sizes.agg(F.max_by("d", F.struct("count", -F.col("d"))).alias("d")).first()["d"]


def quantized(vectors: DataFrame, column: str, scale: int = 64, shift: int = 1_000_000, to: str = "x") -> DataFrame:
    """Usable rows with ``floor(scale * entry) + shift`` as an array of longs."""
    require(vectors, column)
    entry = F.transform(column, lambda c: c.cast("double") * F.lit(float(scale)))
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    fits = F.size(column) == F.lit(_length_of(vectors, column))
    given = vectors.where(F.coalesce(usable & fits, F.lit(False)))
    # a filter may be pushed below the projection but never out of the lambda, so no entry overflows
    safe = F.transform(entry, lambda c: F.floor(F.when(F.abs(c) < F.lit(LARGEST), c)) + F.lit(shift).cast("long"))
    return given.withColumn(to, safe)


@dataclass(frozen=True)
class Whitening:
    """A fitted model: counts, exact sums, and the leading components as columns."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def base(self) -> np.ndarray:
        """Floor of the mean, per dimension."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> list[int]:
        """What the sums hold beyond ``n`` times the floor."""
        return [s % self.n for s in self.sums]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """Whole vectors less the mean; only the last subtraction rounds."""
        return (rows - self.base).astype(np.float64) - np.array([float(Fraction(r, self.n)) for r in self.rests])

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, rows: np.ndarray) -> list[int]:
        """Per row the sum over dimensions of ``(n * x - S) ** 2``, exact."""
        near, rests = rows - self.base, np.array(self.rests, dtype=object)
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most**2 * rows.shape[1] < 1 << 63:
            return ((near * self.n - rests.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((near.astype(object) * self.n - rests) ** 2).sum(axis=1).tolist()


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``F`` with ``F @ F.T == matrix``: rows in the order given, triangular in pivot order.

    Ends where the largest remaining pivot is rounding noise; the number of columns is the rank.
    """
    d = len(matrix)
    rest = np.diag(matrix).astype(np.float64).copy()
    factor = np.zeros((d, d))
    noise = d * np.finfo(np.float64).eps * rest.max(initial=0.0)
    for k in range(d):
        pivot = int(np.argmax(rest))
        if rest[pivot] <= noise:
            return factor[:, :k]
        column = (matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(rest[pivot])
        column[rest == -1.0] = 0.0  # rows already used: exactly triangular
        factor[:, k] = column
        rest = np.where(rest == -1.0, -1.0, np.maximum(rest - column**2, 0.0))
        rest[pivot] = -1.0
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor @ factor.T``, falling, and unit components as columns.

    Pairs of columns are rotated, a round of disjoint pairs at a time, until all are orthogonal to
    working precision.
    """
    columns = factor.T.copy()  # rows are contiguous
    r = len(columns)
    if r == 0:
        return np.empty(0), np.empty((len(factor), 0))
    players = list(range(r + r % 2))
    tolerance = np.finfo(np.float64).eps
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(a, b) for a, b in zip(players[:half], reversed(players[half:])) if a < r and b < r]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            i, j = map(np.array, zip(*pairs))
            x, y = columns[i], columns[j]
            a, b, c = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(a * b)
            turn = np.abs(c) > tolerance * size
            largest = max(largest, float((np.abs(c[turn]) / size[turn]).max(initial=0.0)))
            if not turn.any():
                continue
            i, j, x, y, a, b, c = i[turn], j[turn], x[turn], y[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2.0 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1.0 / np.hypot(1.0, t)
            sin = cos * t
            columns[i] = cos[:, None] * x - sin[:, None] * y
            columns[j] = sin[:, None] * x + cos[:, None] * y
        if largest <= r * tolerance:
            break
    values = (columns * columns).sum(1)
    order = np.argsort(-values, kind="stable")
    return values[order], (columns[order] / np.sqrt(values[order])[:, None]).T


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _blocks(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Parts whose sums of products doubles hold exactly; one row of large numbers comes as objects."""
    for at in range(0, len(rows), BLOCK_ROWS):
        block = rows[at : at + BLOCK_ROWS]
        most = int(np.abs(block).max(initial=0))
        if most * most * len(block) <= EXACT:
            yield block.astype(np.float64)
        else:
            yield block.astype(object)


_MOMENT = "i int, j int, v decimal(38,0)"


def _moments(distinct: DataFrame, column: str, d: int, base: np.ndarray | None) -> dict[tuple[int, int], int]:
    """Sums over all rows: of each dimension (``base`` None), else of products about ``base``.

    A task gives one row per number it holds, and Spark adds them as decimals: exact in any order.
    """
    upper_i, upper_j = (np.arange(d), np.zeros(d, int)) if base is None else np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper_i), dtype=object)
        met = False
        for batch in batches:
            rows = _rows(batch.column(column), d)
            met = met or len(rows) > 0
            for block in _blocks(rows if base is None else rows - base):
                found = block.sum(axis=0) if base is None else (block.T @ block)[upper_i, upper_j]
                total = total + np.array([int(v) for v in found], dtype=object)
        if met:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper_i, pa.int32()), pa.array(upper_j, pa.int32()), values], ["i", "j", "v"]
            )

    summed = distinct.select(column).mapInArrow(add, _MOMENT).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(row["i"], row["j"]): int(row["v"]) for row in summed.collect()}  # d or d * (d + 1) / 2 rows


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The model of the distinct vectors, and these as a written table. None where nothing varies.

    Vectors are arrays of longs of one length.
    """
    distinct = written(vectors.select(column).distinct(), "distinct-vectors")
    n = distinct.count()
    if n < 2:
        return None, distinct
    d = distinct.select(F.size(column).alias("d")).first()["d"]
    sums = _moments(distinct, column, d, None)
    sums = tuple(sums[i, 0] for i in range(d))
    base = np.array([s // n for s in sums], np.int64)
    products = _moments(distinct, column, d, base)
    rests = [s % n for s in sums]
    covariance = np.zeros((d, d))
    trace = Fraction(0)
    for (i, j), v in products.items():
        # about the mean itself, not its floor
        exact = Fraction(n * v - rests[i] * rests[j], n * n)
        covariance[i, j] = covariance[j, i] = float(exact)
        trace += exact if i == j else 0
    values, columns = one_sided_jacobi(pivoted_cholesky(covariance))
    model = Whitening(n, sums, values[:components], columns[:, :components], float(trace))
    return model, distinct


def whiten(vectors: DataFrame, model: Whitening, column: str = "x") -> DataFrame:
    """Every row once per component: its number from 1, ``deviation`` and the ``whitened`` value.

    Other columns come along except ``column``.
    """
    require(vectors, column)
    kept = [c for c in vectors.columns if c not in RESULT and c != column]
    shared, d, k = ship(vectors.sparkSession, model), len(model.sums), len(model.eigenvalues)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Whitening = shipped(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                rows = _rows(batch.column(column), d)
                index = np.repeat(np.arange(len(rows)), k)
                deviation = pa.array([Decimal(v) for v in fitted.deviations(rows)], pa.decimal128(38, 0))
                made = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    deviation.take(pa.array(index)),
                    pa.array(fitted.whitened(rows).ravel()),
                ]
                carried = [batch.column(c).take(pa.array(index)) for c in kept]
                yield pa.RecordBatch.from_arrays(carried + made, kept + list(RESULT))

    added = [
        StructField("component", IntegerType()),
        StructField("deviation", DecimalType(38, 0)),
        StructField("whitened", DoubleType()),
    ]
    schema = StructType([vectors.schema[c] for c in kept] + added)
    return vectors.select(*kept, column).mapInArrow(turn, schema)


def identity_error(distinct: DataFrame, model: Whitening, column: str = "x") -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity.

    Measured over the rows. The whitened values are centred by construction; what rounding leaves of
    their mean is taken off.
    """
    shared, d, k = ship(distinct.sparkSession, model), len(model.sums), len(model.eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Whitening = shipped(shared)
        total = np.zeros((k + 1, k))
        for batch in batches:
            rows = _rows(batch.column(column), d)
            for at in range(0, len(rows), BLOCK_ROWS):
                values = fitted.whitened(rows[at : at + BLOCK_ROWS])
                total += np.vstack([values.T @ values, values.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"]
        )

    summed = distinct.select(column).mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((k + 1, k))
    for row in summed.collect():  # k * (k + 1) rows
        whole[row["i"], row["j"]] = row["v"] / model.n
    return float(np.abs(whole[:k] - np.outer(whole[k], whole[k]) - np.eye(k)).max(initial=0.0))
