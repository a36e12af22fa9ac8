"""Whitening against NumPy's eigenvalues and exact whole numbers."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilequery.llm import whitening


def symmetric(n, seed):
    a = np.random.default_rng(seed).standard_normal((n, n))
    return a + a.T


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.floats(-4, 4), st.booleans())
def test_inertia(n, seed, shift, whole):
    a = symmetric(n, seed) - shift * np.eye(n)
    a = np.round(a) if whole else a  # whole numbers give zero pivots on the diagonal
    values = np.linalg.eigvalsh(a)
    low, zero, high = whitening.inertia(a)
    assert low + zero + high == n
    near = (np.abs(values) < 1e-9).sum()
    assert low <= (values < 1e-9).sum() and high <= (values > -1e-9).sum() and (near or (low, high) == ((values < 0).sum(), (values > 0).sum()))


def test_inertia_of_zero_diagonal():
    a = np.array([[0, 2, 0], [2, 0, 1], [0, 1, 0.0]])
    assert whitening.inertia(a) == (1, 1, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)


@pytest.mark.parametrize("spectrum", [
    [9, 5, 3, 1, 0.5], [7, 7, 7, 2, 1], [5, 5 * (1 + 1e-13), 5 * (1 - 1e-13), 1, 0], [4, 4 * (1 - 1e-9), 1e-6, 1e-9, 0], [1] * 5, [3, 0, 0, 0, 0], [1e12, 1, 1e-3, 0, 0],
])
def test_leading(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((5, 5)))
    v = q @ np.diag(spectrum) @ q.T
    v = (v + v.T) / 2
    values, x = whitening.leading(v, 4)
    scale = np.abs(v).max()
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=0, atol=1e-13 * scale * 5)
    assert np.allclose(x.T @ x, np.eye(4), atol=1e-13) and np.abs(v @ x - x * values).max() < 1e-12 * scale


def test_leading_of_many():
    v = symmetric(64, 1) @ symmetric(64, 1)
    values, x = whitening.leading(v, 16)
    want, axes = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:16], rtol=1e-12)
    assert np.allclose(np.abs(np.einsum("ij,ij->j", x, axes[:, ::-1][:, :16])), 1, atol=1e-10)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 20)) * np.linspace(1, 3, 20)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist(), 0), (500, x[9].tolist(), 1), (None, x[10].tolist(), 1), (501, (x[11] + 1e-9).tolist(), 1)]  # repeated vectors
    rows += [(600, None, 1), (601, [None] + [1.0] * 19, 1), (602, [float("nan")] * 20, 2), (603, [float("inf")] + [0.0] * 19, 2), (604, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(4)
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 20 and all(c is not None and np.isfinite(c) for c in r[1])]
    whole = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in r[1]) for r in kept]
    fit = sorted(set(whole))
    n, s = len(fit), np.array(fit, object).sum(0)
    z = np.array(fit, float) - s.astype(float) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    assert len(got) == len(kept) * 16 and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for row, w in zip(kept, whole):
        for k in range(16):
            r = by[row[0], k + 1][0]
            assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(w, s))
            want = float((np.array(w, float) - s.astype(float) / n) @ u[:, k] / np.sqrt(e[k]))
            sign.setdefault(k, np.sign(want * r.whitened) or 1)
            assert abs(r.whitened * sign[k] - want) < 1e-8
            assert abs(r.explained - e[k] / np.trace(v)) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema), "vec_id", "embedding").count() == 0
    two = [(i, [float(i), 0.0]) for i in range(5)] + [(10 + i, [float(i), 1.0 * (i % 2), 2.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(two, schema), "vec_id", "embedding").collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, 1) for i in range(5)] + [(10 + i, k) for i in range(6) for k in (1, 2)]
    assert {r.n for r in got} == {5, 6}
    far = [(i, [2.0**40 + i, -(2.0**41) * i]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert len(got) >= 4 and all(r.deviation is None or r.deviation >= 0 for r in got)
