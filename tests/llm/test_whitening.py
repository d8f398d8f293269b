"""Rank-one spectra against numpy, and whitening against a direct eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from flowsieve.llm import spectra, whitening

SHAPES = {
    "plain": lambda g: g.normal(size=(200, 24)) * 10,
    "fewer rows than dimensions": lambda g: g.normal(size=(9, 24)),
    "repeats": lambda g: np.repeat(g.normal(size=(5, 8)), 40, 0),
    "axes": lambda g: np.round(np.eye(6)[g.integers(0, 6, 200)] * 5),
    "scales": lambda g: g.normal(size=(150, 16)) * 10.0 ** -np.arange(16),
    "constant": lambda g: np.ones((30, 4)),
    "one dimension": lambda g: g.normal(size=(30, 1)),
}


@pytest.mark.parametrize("kind", SHAPES)
def test_rank_one_updates_and_merges(kind):
    x = SHAPES[kind](np.random.default_rng(3))
    n, dims = x.shape
    y = x - x.mean(0)
    scatter = y.T @ y
    size = max(np.abs(scatter).max(), 1e-300)
    one, a, b = (spectra.Spectrum(dims) for _ in range(3))
    for k, row in enumerate(x):
        one.add(row)
        (a if k % 3 else b).add(row)
    a.merge(b)
    for s in (one, a):
        assert s.rows == n and np.allclose(s.mean, x.mean(0), atol=1e-12)
        assert np.abs(s.basis.T @ s.basis - np.eye(dims)).max() < 1e-13 and (np.diff(s.d) >= 0).all()
        assert np.abs(s.basis * s.d @ s.basis.T - scatter).max() < 1e-12 * size + 1e-25


def expected(x, components=16):
    y = np.unique(np.floor(64 * x).astype(int), axis=0)
    mean = y.mean(0)
    values, vectors = np.linalg.eigh((y - mean).T @ (y - mean) / len(y))
    return len(y), y.sum(0), mean, values[::-1], vectors[:, ::-1][:, :components]


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + k, row.tolist(), 1, 2.0) for k, row in enumerate(x)], "vec_id bigint, embedding array<float>, n int, whitened double")


def compare(found, x, components):
    n, total, mean, values, vectors = expected(x)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == len(x) * components
    grid = np.floor(64 * x).astype(int)
    for c in range(components):
        want = (grid - mean) @ vectors[:, c] / np.sqrt(values[c])
        got = np.array([by[k, c + 1]["whitened"] for k in range(len(x))])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert by[0, c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    for k, row in enumerate(grid):
        assert by[k, 1]["deviation"] == sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, total))
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in found)


def test_whitened(spark, rows):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 20)) * np.linspace(0.2, 3, 20) + 5).astype("f4").astype(float)
    # a third of all rows hold one vector
    x = np.concatenate([x, np.repeat(x[:1], 150, 0)])
    df = frame(spark, x).repartition(40)
    compare(rows(whitening.whitened(df)), x, 16)
    odd = spark.createDataFrame([(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] * 20)], "vec_id bigint, embedding array<float>")
    compare(rows(whitening.whitened(df.select("vec_id", "embedding").union(odd))), x, 16)


def test_rank_and_edges(spark, rows):
    x = np.repeat(np.array([[1.0, 2, 3], [2, 2, 3], [1, 4, 3]]), 4, 0)
    compare(rows(whitening.whitened(frame(spark, x))), x, 2)
    same = frame(spark, np.ones((5, 3)))
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.limit(0)).count() == 0
    assert whitening.whitened(same).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError, match="3 to 4"):
        whitening.whitened(same.union(frame(spark, np.ones((1, 4)))))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(same.union(frame(spark, np.full((1, 3), 1e30)))).count()


def test_null_and_repeated_ids(spark, rows):
    table = [(None, [1.0, 0.5]), (None, [0.25, 3.0]), (7, [1.0, 0.5]), (7, [2.0, 2.0])]
    found = rows(whitening.whitened(spark.createDataFrame(table, "vec_id bigint, embedding array<double>")))
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in found) == sorted((str(k), c, 3) for k, _ in table for c in (1, 2))
