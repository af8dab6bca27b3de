"""Whitening against dense linear algebra on the driver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gleaner.llm import whitening
from gleaner.llm.whitening import fit, identity_error, one_sided_jacobi, pivoted_cholesky, quantized, whiten


def frame_of(spark, vectors, **more):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "y", 1.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, base double")


def plain(vectors):
    """Distinct quantized vectors, exact counts, and the eigenvalues of their covariance."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    distinct = [list(v) for v in sorted(set(map(tuple, x)))]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    y = np.array([[float(c * n - s) / n for c, s in zip(v, sums)] for v in distinct])
    values, columns = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, values[::-1], columns[:, ::-1]


def whitened_of(spark, vectors, components=16):
    given = quantized(frame_of(spark, vectors), "embedding")
    model, distinct = fit(given, components=components)
    return model, distinct, given


def test_against_dense(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, 20)) @ np.diag(np.linspace(2, 0.05, 20))
    vectors = np.vstack([vectors, vectors[:7], vectors[:7]])
    model, distinct, given = whitened_of(spark, vectors)
    x, n, sums, values, columns = plain(vectors)
    assert (model.n, list(model.sums)) == (n, sums)
    assert np.allclose(model.eigenvalues, values[:16], rtol=1e-10)
    assert np.isclose(model.trace, values.sum(), rtol=1e-12)
    assert np.allclose(np.abs((model.components * columns[:, :16]).sum(0)), 1, atol=1e-9)
    assert identity_error(distinct, model) < 1e-10
    rows = whiten(given.drop("embedding"), model).collect()
    assert len(rows) == 16 * len(vectors) and {r["base"] for r in rows} == {1.5}
    for r in rows:
        v = x[r["vec_id"]]
        assert int(r["deviation"]) == sum((n * c - s) ** 2 for c, s in zip(v, sums))
        u = model.components[:, r["component"] - 1]
        expected = sum((c - s / n) * w for c, s, w in zip(v, sums, u)) / math.sqrt(model.eigenvalues[r["component"] - 1])
        assert abs(r["whitened"] - expected) < 1e-6


def test_fewer_dimensions_than_components(spark):
    """Vectors in a plane: two components, however many are asked for."""
    vectors = [(i % 5, j % 7, (i % 5) + (j % 7), 0) for i in range(9) for j in range(9)]
    model, distinct, given = whitened_of(spark, vectors)
    assert len(model.eigenvalues) == 2
    assert identity_error(distinct, model) < 1e-12
    assert whiten(given, model).count() == 2 * len(vectors)


def test_dropped_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, nan], [inf, 1.0], [None, 2.0], [1.0], [3e38, 1.0], [0.0, 0.0], [1.0, 2.0], [1.0, 2.0], [3.0, 1.0]]
    model, distinct, given = whitened_of(spark, vectors)
    assert model.n == 3
    assert {r["vec_id"] for r in whiten(given, model).collect()} == {7, 8, 9, 10}
    huge = [[1e16, 1.0], [-1e16, 2.0], [5e15, -3.0]]
    model, distinct, given = whitened_of(spark, huge)
    x, n, sums, values, _ = plain(huge)
    assert np.allclose(model.eigenvalues[:1], values[:1], rtol=1e-12)
    found = {r["vec_id"]: int(r["deviation"]) for r in whiten(given, model).collect()}
    assert found == {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]]])
def test_nothing_varies(spark, vectors):
    assert whitened_of(spark, vectors)[0] is None


def test_factor_and_rotation():
    draw = np.random.default_rng(1)
    for d, r in ((40, 40), (40, 9), (5, 5), (1, 1)):
        half = draw.normal(size=(d, r)) * np.logspace(0, -4, r)
        matrix = half @ half.T
        factor = pivoted_cholesky(matrix)
        assert factor.shape == (d, r) and np.allclose(factor @ factor.T, matrix, atol=1e-13)
        # triangular once rows are put in pivot order
        order = np.argsort([np.flatnonzero(row)[-1] if row.any() else -1 for row in factor], kind="stable")
        assert np.allclose(np.triu(factor[order][:r], 1), 0)
        values, columns = one_sided_jacobi(factor)
        assert np.allclose(columns.T @ columns, np.eye(r), atol=1e-13)
        assert np.allclose(matrix @ columns, columns * values, atol=1e-12)


def test_blocks_are_exact():
    rows = np.array([[1 << 40, 3], [5, -(1 << 41)]], np.int64)
    total = sum((b.T @ b)[0, 0] for b in whitening._blocks(rows))
    assert int(total) == (1 << 80) + 25
