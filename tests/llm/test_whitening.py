"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import whitening

VECTORS = "vec_id long, embedding array<float>"


def by_hand(x):
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return y, e[::-1], v[:, ::-1], ((n * x - s).astype(object) ** 2).sum(axis=1)


def test_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STACK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(400, 40)) * np.geomspace(5, 0.05, 40) + rng.normal(size=40)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], VECTORS).repartition(7)
    got = whitening.whitened(rows).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 400 * 32 and (got.n == 400).all()
    y, e, v, deviation = by_hand(np.floor(64 * c.astype(float)).astype(np.int64) + 1_000_000)
    mine = got.whitened.to_numpy().reshape(400, 32)
    theirs = y @ v[:, :32] / np.sqrt(e[:32])
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine * sign - theirs).max() < 1e-8
    assert np.allclose(got.explained[:32], e[:32] / e.sum(), rtol=1e-10)
    assert got.deviation[got.component == 1].tolist() == list(deviation)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    w = mine - mine.mean(axis=0)
    assert math.isclose(got.identity_error.iloc[0], np.abs(w.T @ w / 400 - np.eye(32)).max(), abs_tol=1e-12)


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), np.triu(rng.normal(size=(d, d))) * 10.0 ** -np.arange(d), np.ones((d, d)), np.zeros((d, d)), np.eye(d) * 1e150):
        lengths, v = whitening.jacobi(a)
        assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-10, atol=1e-12 * np.abs(a).max())
        assert np.allclose(v.T @ v, np.eye(d)) and np.allclose(np.linalg.norm(a @ v, axis=0), lengths)


def test_small_singular_values_are_accurate():
    """Columns of lengths from 1 to 1e-12 keep their relative accuracy, which a covariance would lose."""
    d = 7
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    lengths, _ = whitening.jacobi(q * 10.0 ** (-2 * np.arange(d)))
    assert np.allclose(lengths, 10.0 ** (-2 * np.arange(d)), rtol=1e-9)


def test_edges(spark):
    good = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [-2.0, 0.125]), (3, [-2.0, 0.125]), (None, [0.0, 3.0])]
    odd = [(5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [3e38, 0.0])]
    rows = spark.createDataFrame(good + odd, VECTORS).select("*", *[F.lit("clash").alias(c) for c in ("vector", "n", "size", "component", "part")])
    got = whitening.whitened(rows).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in good for _ in range(2)) and {r.n for r in got} == {5}
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    want = by_hand(x)[3]
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(good, want))
    assert whitening.whitened(rows.limit(0)).collect() == []
    assert whitening.whitened(rows.where("vec_id = 1")).collect() == []  # one vector has no variance
    assert whitening.whitened(rows.where("vec_id >= 5")).collect() == []
    flat = spark.createDataFrame([(i, [1.0, float(i), float(i)]) for i in range(9)], VECTORS)  # a constant dimension and a repeated one
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}


def test_lengths_are_whitened_apart(spark):
    rng = np.random.default_rng(6)
    vectors = [(k, rng.normal(size=2 + k % 3).tolist()) for k in range(90)]
    got = whitening.whitened(spark.createDataFrame(vectors, VECTORS)).collect()
    for d in (2, 3, 4):
        mine = {r.vec_id: r for r in got if r.component == d and len(vectors[r.vec_id][1]) == d}
        assert len(mine) == 30 and {r.n for r in mine.values()} == {30}
        assert math.isclose(sum(r.whitened**2 for r in mine.values()) / 30, 1, rel_tol=1e-9)


def test_wide_entries_stay_exact(spark):
    """Products near 64 bits are exact; beyond, an error is better than lost digits."""
    wide = lambda step: spark.createDataFrame([(k, [float(k * step), -float(k * k)]) for k in range(4)], VECTORS)
    got = {r.vec_id: r.deviation for r in whitening.whitened(wide(2**22)).collect()}
    x = [[64 * k * 2**22 + 10**6, -64 * k * k + 10**6] for k in range(4)]
    s = [sum(c) for c in zip(*x)]
    want = {k: sum((4 * a - b) ** 2 for a, b in zip(x[k], s)) for k in range(4)}
    assert got == want and max(want.values()) > 2**61
    with pytest.raises(Exception, match="too big|too large|overflow|Overflow"):
        whitening.whitened(wide(2**30)).collect()
