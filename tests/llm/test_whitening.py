"""Whitening against numpy's eigenvectors of the covariance, and its steps one by one."""

import math

import numpy as np
import pytest

from packwright.llm import queries as Q
from packwright.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def matrices():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    near = np.r_[np.ones(3) * 5, 5 * (1 - 1e-9), 5 * (1 + 1e-7), np.linspace(4, 1, 25)]
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 20) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    plain = rng.normal(size=(400, 8))
    return {
        "plain": rng.normal(size=(500, 64)), "few rows": rng.normal(size=(3, 64)), "one": np.ones((5, 1)), "equal": np.eye(20),
        "near values": np.linalg.qr(rng.normal(size=(100, 30)))[0] * near @ turn, "graded": rng.normal(size=(400, 64)) * np.logspace(0, -12, 64),
        "graded up": rng.normal(size=(400, 64)) * np.logspace(-12, 0, 64), "wilkinson": np.linalg.cholesky(wilkinson).T,
        "deficient": np.concatenate([plain, np.zeros((400, 4)), plain[:, :3]], axis=1)}


@pytest.mark.parametrize("name", matrices())
def test_singular_values_and_directions(name):
    m = matrices()[name]
    a, b, w = W.bidiagonal(np.linalg.qr(m, mode="r"))
    full = np.diag(a) + np.diag(b, 1) if len(b) else np.diag(a)
    assert np.allclose(w @ (full.T @ full) @ w.T, m.T @ m, atol=1e-12 * np.abs(m.T @ m).max())
    values = W.dqds(a, b)
    true = np.linalg.svd(m, compute_uv=False) ** 2
    solid = true > 1e-20 * true[0]
    assert np.allclose(values[: len(true)][solid], true[solid], rtol=1e-12 if name not in ("graded", "graded up") else 1e-8, atol=0)
    k = int((values > 1e-25 * values[0]).sum())
    u = w @ W.directions(a, b, values, k)
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-11
    assert np.abs(m.T @ (m @ u) - u * values[:k]).max() < 1e-13 * values[0] * len(a)


def usable(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    return [i for i, _ in rows], x


def want(rows, components=8):
    """vec_id, n, deviation, |whitened| columns and explained, by numpy."""
    ids, x = usable(rows)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return ids, n, deviation, np.abs(centred @ u / np.sqrt(e)), e / ((centred**2).sum() / n)


def compare(df, rows, components=8):
    ids, n, deviation, white, explained = want(rows, components)
    got = df.collect()
    assert len(got) == len(ids) * white.shape[1]
    sign = {}
    for r in got:
        i, k = ids.index(r.vec_id), r.component - 1
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(r.whitened) == pytest.approx(white[i, k], abs=1e-8)
        assert r.explained == pytest.approx(explained[k], rel=1e-10)
        assert 0 <= r.identity_error < 1e-9
        sign.setdefault(k, []).append((i, r.whitened))
    values = np.array([[w for _, w in sorted(sign[k])] for k in range(white.shape[1])])
    assert np.abs(values @ values.T / n - np.eye(len(values))).max() < 1e-9  # one sign a component


def renamed(df):
    return df.withColumnRenamed("id", "vec_id")


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    compare(Q.op12_whitening(spark, d), rows)


def test_many_triangles_and_unusable_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=12) * np.linspace(3, 0.1, 12) + 40).tolist()) for i in range(900)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, [None] * 12), (1002, [nan] * 12), (1003, [1.0] * 11 + [-inf])]
    src = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA + ", n int, component string").repartition(40)
    compare(renamed(W.whiten(src)), rows)


def test_defined_cases(spark):
    def run(rows, **options):
        return W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()

    assert run([]) == run([(1, None)]) == run([(1, [1.0, 2.0])]) == run([(1, [1.0, 2.0])] * 4) == run([(1, [])]) == []
    rows = [(1, [0.0, 5.0]), (1, [1.0, 5.0]), (None, [1.0, 5.0]), (4, [2.0])]
    out = run(rows)  # one dimension varies, one vector is of another length
    assert [(r.component, r.n) for r in out] == [(1, 3)] * 3 and {r.explained for r in out} == {1.0}
    big = run([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e12, 0.0])])
    assert {r.id: r.deviation for r in big} == {1: None, 2: None}  # no long holds them; 3e12 is no entry


def test_exact_deviations_beyond_doubles():
    centre = W.Centre(7, np.array([3, 5]), np.array([2, 6]))
    x = np.array([[1 << 28, 5], [3, -(1 << 28)], [3, 5]])
    assert centre.squares(x) == [sum((7 * int(c) - s) ** 2 for c, s in zip(r, (23, 41))) for r in x]
    assert centre.squares(x * 4)[:2] == [None, None]
