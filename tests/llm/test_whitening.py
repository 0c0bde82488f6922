import math
import random

import numpy as np
import pytest

from fieldloom.llm import whitening


def brute(rows):
    x = [[math.floor(64 * c) + 1_000_000 for c in e] for e in rows]
    n, total = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, total)) for r in x]
    centred = np.array([[(n * v - s) / n for v, s in zip(r, total)] for r in x])
    v = centred.T @ centred / n
    return n, deviation, centred, v


def rows_of(n, dim, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + rng.normal(size=dim)).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize(("n", "dim"), [(200, 5), (700, 40), (300, 70)])
def test_rows_are_brute_force(spark, n, dim):
    rows = rows_of(n, dim, n)
    got = whitening.whiten(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(5)).collect()
    n, deviation, centred, v = brute(rows)
    k = min(32, dim)
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    w = np.zeros((n, k))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-9)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((w * want).sum(0))
    assert np.allclose(w, want * signs, atol=1e-6)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-7
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-7


def test_tiles_add_up(spark):
    """Small tiles and row blocks, a last block that is narrower, and many tasks a tile."""
    rows = rows_of(333, 23, 7)
    df = whitening._usable(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").repartition(4))
    _, _, _, v = brute(rows)
    fitted = whitening.fit(df, tile=5, block_rows=16)
    assert np.allclose(fitted.vectors @ np.diag(fitted.values) @ fitted.vectors.T, v, rtol=1e-10, atol=1e-9 * np.abs(v).max())


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = rows_of(40, 3, 1)
    bad = [None, [], [1.0, None, 2.0], [nan, 0.0, 0.0], [0.0, inf, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = [(i % 30, e, "k", i) for i, e in enumerate(good)] + [(None, good[0], "k", 0)] + [(100 + i, e, "k", i) for i, e in enumerate(bad)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n long")
    got = whitening.whiten(df).collect()
    assert len(got) == 41 * 3 and {r.n for r in got} == {41}
    assert sum(r.vec_id is None for r in got) == 3 and not any((r.vec_id or 0) >= 100 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id >= 100 and vec_id <> 105 and vec_id <> 106")).count() == 0
    # equal rows: no variance at all; a constant dimension: one component without variance
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert len(flat) == 10 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in flat)
    part = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in part if r.whitened is None} == {2} and part[0].identity_error < 1e-9


def test_numbers_of_any_size():
    c = np.array([[1e14, -3.0], [2e14, 5.5]])
    d = whitening.deviations(whitening.whole_numbers(c), 2, whitening.whole_numbers(c).sum(0).astype(object))
    assert d.tolist() == [[64 * 10**14 - 64 * 2 * 10**14, -192 - 352], [64 * 10**14, 352 + 192]]
    assert whitening.squared_lengths(d) == [None, None]
    assert whitening.squared_lengths(np.array([[3, 4]])) == [25]
