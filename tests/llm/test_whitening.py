import math

import numpy as np
import pytest
from stratalog.llm import queries, whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_components_of_random_matrices(n):
    draw = np.random.default_rng(n)
    a = draw.normal(size=(n, n))
    a = a @ a.T
    values, vectors = whitening.components_of(a, 8)
    known = np.linalg.eigvalsh(a)[::-1][:8]
    assert np.allclose(values, known, rtol=0, atol=1e-13 * known[0])
    assert np.allclose(a @ vectors, vectors * values, rtol=0, atol=1e-13 * n * known[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), rtol=0, atol=1e-13)


@pytest.mark.parametrize("spectrum", [[1] * 12, [0] * 12, [5] * 6 + [1] * 6, [4] + [0] * 11, list(10.0 ** -np.arange(12)), [3, 3 + 1e-11, 3 - 1e-11] + [1] * 9, [-2, -1, 0, 1, 2, 3] * 2])
def test_equal_close_and_empty_spectra(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(12, 12)))
    a = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.components_of(a, 8)
    scale = max(1e-300, np.abs(spectrum).max())
    assert np.allclose(values, np.sort(spectrum)[::-1][:8], rtol=0, atol=1e-13 * scale)
    assert np.allclose(a @ vectors, vectors * values, rtol=0, atol=1e-12 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(8), rtol=0, atol=1e-12)


def test_polar_factor():
    a = np.random.default_rng(4).normal(size=(30, 30))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.allclose(u @ u, np.eye(30), atol=1e-13) and np.all(np.linalg.eigvalsh(u @ a) > -1e-12)


def expected(rows, components=8):
    """Everything by plain numpy, deviations in whole numbers."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in usable]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return usable, n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_against_numpy(spark, tmp_path):
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(700, 12)) * np.linspace(1, 0.1, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [0.0] * 12)]
    schema = "vec_id long, embedding array<float>, v string, deviation string, whitened string, n string"
    spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).repartition(13).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.embedding_whitening(spark, str(tmp_path)).collect()
    usable, n, deviation, white, explained = expected(rows)
    assert len(found) == 8 * n and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, 9))
    assert sorted(((r.vec_id, r.deviation) for r in found if r.component == 1), key=str) == sorted(zip([i for i, _ in usable], deviation), key=str)
    for k in range(8):
        ours = np.array(sorted([(r.vec_id, r.deviation, r.whitened) for r in found if r.component == k + 1 and r.vec_id is not None]))
        theirs = np.array(sorted([(i, d, w) for (i, _), d, w in zip(usable, deviation, white[:, k]) if i is not None]))
        sign = np.sign(ours[0, 2] * theirs[0, 2])
        assert np.allclose(ours[:, 2], sign * theirs[:, 2], rtol=0, atol=1e-9)
        assert all(abs(r.explained / explained[k] - 1) < 1e-9 for r in found if r.component == k + 1)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_defined_results(spark):
    def of(rows, **args):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        model = whitening.fit(df, **args)
        white = whitening.apply(df, model)
        return model, whitening.identity_error(white, model), sorted((tuple(r) for r in white.collect()), key=str)

    assert of([]) == (None, None, [])
    assert of([(1, None), (2, [None])]) == (None, None, [])
    model, error, rows = of([(1, [0.5, 2.0])])
    assert error is None and model.explained() == [None, None] and rows == [(1, 0, [None, None])]
    # no variance in the second dimension
    model, error, rows = of([(1, [0.0, 7.0]), (2, [1.0, 7.0])])
    assert model.explained() == [1.0, 0.0] and error < 1e-12
    assert [(r[0], r[1], abs(r[2][0]), r[2][1]) for r in rows] == [(1, 1024**2, 1.0, None), (2, 1024**2, 1.0, None)]
    # another dimension than most, and numbers beyond 64 bits
    model, error, rows = of([(1, [0.0]), (2, [1e30]), (3, [-1e300]), (4, [1.0, 2.0])])
    assert model.n == 3 and [r[0] for r in rows] == [1, 2, 3] and [r[1] for r in rows][1:] == [None, None]
