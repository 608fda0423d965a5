"""Whitening against a dense eigenvalue decomposition and exact whole numbers."""
import math

import numpy as np
import pytest

from codesieve.llm import whitening as T


def dense(values):
    """(distinct x vectors as Python ints, n, sums, covariance) of one length."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in values]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    return x, n, sums, y.T @ y / n


@pytest.mark.parametrize(("dim", "k", "spread"), [(5, 16, 3), (40, 16, 1.2), (150, 16, 1.05), (150, 4, 1.0), (90, 6, 1.5)])
def test_pairs(dim, k, spread):
    """Equal, close and far eigenvalues; restarts where the matrix is wide."""
    rng = np.random.default_rng(dim)
    own = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    eig = 100 * spread ** -np.arange(dim, dtype=float)
    matrix = own * eig @ own.T
    matrix = (matrix + matrix.T) / 2
    used = []
    values, vectors, residuals = T.leading_pairs(lambda q: used.append(q.shape[1]) or matrix @ q, dim, k)
    k = min(k, dim)
    assert np.abs(values - eig[:k]).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-11 and residuals.max() < 1e-11
    assert len(used) < 400


def test_minres():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    held = np.linalg.qr(rng.normal(size=(30, 3)))[0]
    p = np.eye(30) - held @ held.T
    rhs, theta = p @ rng.normal(size=(30, 4)), np.array([0.1, 3.0, -2.0, 9.0])
    got = T.minres(lambda q: a @ q, held, theta, rhs, 60, 1e-12)
    for j in range(4):
        assert np.linalg.norm(p @ (a - theta[j] * np.eye(30)) @ p @ got[:, j] - rhs[:, j]) < 1e-7


def check(got, values, ids, k=16):
    x, n, sums, covariance = dense(values)
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(ids)
    k = min(k, len(e))
    white = {c: np.array([by[i][c].whitened for i in ids]) for c in range(1, k + 1)}
    for c in range(1, k + 1):
        want = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x]) @ v[:, c - 1] / math.sqrt(e[c - 1])
        assert min(np.abs(white[c] - want).max(), np.abs(white[c] + want).max()) < 1e-8, c
    for i, row in zip(ids, x, strict=True):
        for c, r in by[i].items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
            assert abs(r.explained / (e[c - 1] / np.trace(covariance)) - 1) < 1e-9 and r.identity_error < 1e-9 and len(by[i]) == k


def test_whitening(spark):
    rng = np.random.default_rng(11)
    v = (rng.normal(size=(700, 24)) * np.linspace(1, 3, 24)).astype(np.float32)
    v[200:440] = v[200]  # a third of all rows, once in the fit
    rows = [(i, x.tolist(), 1, 2) for i, x in enumerate(v)]
    odd = [(2000, None, 0, 0), (2001, [1.0, None] * 12, 0, 0), (2002, [float("nan")] * 24, 0, 0), (2003, [float("-inf")] * 24, 0, 0), (2004, [], 0, 0),
           (2005, [7.0], 0, 0), (2006, [7.0], 0, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component int, n int").repartition(70)
    check(T.whiten(table).collect(), v, range(700))
    assert T.whiten(table.where("vec_id >= 2000")).count() == T.whiten(table.where("1 = 0")).count() == 0


def test_repeated_ids_null_ids_and_other_lengths(spark):
    rng = np.random.default_rng(12)
    v, u = rng.normal(size=(40, 3)), rng.normal(size=(9, 2)) * 1e5
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100 + i, x.tolist()) for i, x in enumerate(u)] + [(None, v[0].tolist()), (0, v[0].tolist())]
    got = T.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    once = {(r.vec_id, r.component): r for r in got}.values()
    assert len(got) == 42 * 3 + 9 * 2 and sum(r.vec_id is None for r in got) == 3
    check([r for r in once if r.vec_id is not None and r.vec_id < 100], v, range(40))
    check([r for r in once if r.vec_id is not None and r.vec_id >= 100], u, range(100, 109))


def test_deviation_beyond_63_bits(spark):
    rows = [(0, [0.0, 1.0]), (1, [1e11, 2.0]), (2, [-1e11, 9.0])]
    got = T.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.deviation is None) for r in got} == {(0, False), (1, True), (2, True)}
