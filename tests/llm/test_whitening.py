"""Operator 11 against numpy's eigenvalues and exact integer arithmetic."""

import math

import numpy as np
import pytest

from jobloom.llm.whitening import components, op11_whitening, polar_factor, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = (x - np.array([s / n for s in sums], dtype=object)).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    return n, deviation, y @ vectors / np.sqrt(np.where(values > 1e-13 * values[0], values, np.inf)), values / values.sum()


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 130])
def test_components_random(size):
    a = np.random.default_rng(size).standard_normal((size, 2 * size))
    v = a @ a.T
    values, vectors = components(v, min(size, 8))
    want, basis = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:8], rtol=1e-12)
    assert np.allclose(np.abs(vectors.T @ basis[:, ::-1][:, :8]), np.eye(len(values)), atol=1e-9)


@pytest.mark.parametrize("values", [[5, 5, 5, 5], [9, 4, 4, 4, 1, 1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0], [1, 1 - 1e-13, 0.5], [1e6, 1, 1e-6, 0], [3, 2, 1]])
def test_components_clusters(values):
    size = len(values)
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((size, size)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    got, vectors = components(v, size)
    assert np.allclose(got, sorted(values, reverse=True), atol=1e-13 * max(1, max(values)))
    assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13)
    assert np.linalg.norm(v @ vectors - vectors * got) <= 1e-12 * max(1.0, np.linalg.norm(v))


def test_polar_factor_is_sign():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))[0]
    values = np.concatenate([np.logspace(-12, 2, 15), -np.logspace(-12, 2, 15)])
    u = polar_factor(q @ np.diag(values) @ q.T)
    assert np.allclose(u @ u, np.eye(30), atol=1e-12)
    assert np.allclose(np.diag(q.T @ u @ q)[np.abs(values) > 1e-6], np.sign(values)[np.abs(values) > 1e-6], atol=1e-6)


def compare(rows, want_rows, k=8):
    n, deviation, whitened, explained = brute(want_rows)
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, []).append(r)
    assert len(found) == len(want_rows)
    for (vec, _), d, w in zip(want_rows, deviation, whitened):
        got = sorted(found[vec], key=lambda r: r.component)
        assert [r.component for r in got] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in got} == {(n, d)}
        assert np.allclose([abs(r.whitened) for r in got], np.abs(w[:k]), atol=1e-7)
        assert np.allclose([r.explained for r in got], explained[:k], rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(op11_whitening(spark, SF).collect(), [(r.vec_id, r.embedding) for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(10)]) for i in range(40)]
    good += [(100, good[0][1]), (101, [1e3] + good[1][1][1:])]
    bad = [(200, None), (201, []), (202, [1.0, None] + [0.0] * 8), (203, [float("nan")] * 10), (204, [float("inf")] + [0.0] * 9),
           (205, [1.0, 2.0]), (206, [1e30] + [0.0] * 9)]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], SCHEMA + ", component string")
    compare(whiten(df.repartition(7)).collect(), good)


def test_degenerate(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    rows = whiten(spark.createDataFrame([(None, [0.0, 1.0]), (7, [1.0, 1.0])], SCHEMA)).collect()
    assert {(r.vec_id, r.component, r.n, round(abs(r.whitened), 9)) for r in rows} == {(None, 1, 2, 1.0), (7, 1, 2, 1.0)}


def test_deviation_beyond_long(spark):
    rows = whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [9e11, 1.0]), (3, [0.0, 3.0])], SCHEMA)).collect()
    assert {r.deviation for r in rows} == {None}
