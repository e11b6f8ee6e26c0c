from __future__ import annotations

import math

import numpy as np
import pytest
from lorebook.llm.whitening import deviations, jacobi_davidson, minres, op13_whitening, whiten


def brute(rows):
    """Dense eigenvectors; {row place: (deviation, {component: whitened})}, explained, n."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    z = np.array([[x[k] - sums[k] / n for k in range(d)] for x in fit])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = []
    for i, x in kept:
        c = np.array([x[k] - sums[k] / n for k in range(d)])
        out.append((i, sum((n * x[k] - sums[k]) ** 2 for k in range(d)), c @ u / np.sqrt(e)))
    return out, e / np.trace(v), n


def check(got, rows):
    want, explained, n = brute(rows)
    k = len(explained)
    assert len(got) == k * len(want)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = None
    for i, deviation, w in want:
        mine = [by_id[i][c] for c in range(1, k + 1)]
        values = np.array([r.whitened for r in mine])
        if signs is None and np.abs(w).min() > 1e-3:
            signs = np.sign(values * w)
        assert all(r.deviation == deviation and r.n == n and r.identity_error < 1e-9 for r in mine)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-10)
    assert signs is not None
    for i, _, w in want:
        assert np.allclose([by_id[i][c].whitened for c in range(1, k + 1)], w * signs, atol=1e-8)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as x", "2 as d", "'q' as n", "3 as component", "4 as i")


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    scale = np.linspace(3, 0.2, 24)
    x = (rng.standard_normal((400, 24)) * scale).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a hot vector
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, [float("inf")] + rows[0][1][1:])]
    got = whiten(table(spark, rows).repartition(5)).collect()
    check(got, rows)


def test_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op13_whitening(spark, sf).collect(), rows)


def test_few_dimensions_and_ranks(spark):
    two = [(i, [float(i), float((i * 7) % 5)]) for i in range(9)]
    check(whiten(table(spark, two)).collect(), two)
    one = whiten(table(spark, [(i, [float(i % 3), float(i % 3), 1.0, 0.0, 0.0]) for i in range(12)])).collect()
    assert {r.component for r in one} == {1} and len(one) == 12 and all(abs(r.explained - 1) < 1e-12 and r.n == 3 for r in one)
    # One vector, none, empty vectors; lengths apart from the most frequent one go.
    assert whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, []), (2, None)])).count() == 0
    mixed = whiten(table(spark, [*two, (50, [1.0]), (51, []), (None, [3.0, 3.0]), (None, [3.0, 3.0]), (52, [3e38, 1.0])])).collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in mixed) == sorted([*[i for i, _ in two] * 2, -1, -1, -1, -1])


def test_minres_and_jacobi_davidson_on_hard_spectra():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    for e in (np.arange(60, 0, -1.0), np.r_[[5, 5, 5, 5 - 1e-9], np.linspace(1, 0.5, 56)], np.r_[[1e6, 10, 9.99, 9.98], np.zeros(56)], np.ones(60)):
        a = (q * e) @ q.T
        values, vectors = jacobi_davidson(lambda t, a=a: a @ t, 60, 4)
        assert np.allclose(values, np.sort(e)[::-1][:4], rtol=1e-12, atol=1e-12 * e.max())
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * e.max()
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    a = (q * np.r_[np.linspace(-3, -1, 30), np.linspace(1, 3, 30)]) @ q.T
    b = rng.standard_normal((60, 3))
    b[:, 2] = 0
    x = minres(lambda t: a @ t, b, 80, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-10


@pytest.mark.parametrize("n", [5, 10**6, 10**10])
def test_deviation_is_exact_or_null(n):
    x = np.array([[3, -70000], [1, 2], [2**40, 0]], np.int64)
    sums = [n + 1, -(n * 3)]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
