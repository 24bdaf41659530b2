"""Embedding whitening against numpy's own eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.llm import queries, whitening


def close_spectrum(rng, size):
    """Eigenvalues with ties, near ties, zeros and large gaps."""
    values = rng.choice([0.0, 1.0, 1.0, 1 + 1e-13, 1 + 1e-8, 5.0, 1e6], size)
    return np.sort(values)


@pytest.mark.parametrize("seed", range(40))
def test_rank_one_update(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 20))
    axes = np.linalg.qr(rng.normal(size=(size, size)))[0]
    spectrum = close_spectrum(rng, size) if seed % 2 else np.sort(rng.exponential(size=size))
    vector = rng.normal(size=size) * rng.choice([1e-9, 1, 1e4])
    if seed % 3 == 0:
        # touches few axes, one of them hardly
        vector = axes[:, : size // 2 + 1] @ rng.choice([0.0, 1.0, 1e-12], size // 2 + 1)
    whole = axes @ np.diag(spectrum) @ axes.T + np.outer(vector, vector)
    new_axes, new_spectrum = whitening.rank_one(axes, spectrum, vector)
    scale = max(1.0, np.abs(whole).max())
    assert np.allclose(new_axes.T @ new_axes, np.eye(size), atol=1e-12)
    assert np.allclose(new_axes @ np.diag(new_spectrum) @ new_axes.T, whole, atol=1e-11 * scale)
    assert np.allclose(new_spectrum, np.linalg.eigvalsh(whole), atol=1e-11 * scale)


@pytest.mark.parametrize("seed", range(4))
def test_joined_spectra(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(400, 9)) * [1, 1, 3, 10, 100, 0, 1e3, 1, 5]) + 100_000
    found = whitening.Spectrum.empty(9)
    for rows in np.split(x, [1, 2, 3, 60, 200, 399]):
        one = whitening.Spectrum.empty(9)
        for v in rows:
            one.add(v)
        found.join(one)
    centred = x - x.mean(axis=0)
    assert found.n == 400 and np.allclose(found.mean, x.mean(axis=0))
    assert np.allclose(found.axes @ np.diag(found.spectrum) @ found.axes.T, centred.T @ centred, atol=1e-4)


def expected(vectors, components=8):
    """Per row and component: deviation and whitened value up to sign; and the shares."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:components] > 1e-10 * values.sum()).sum())
    return np.square(n * x - sums).sum(axis=1), centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(rows, ids, vectors):
    deviation, whitened, explained = expected(vectors)
    got = rows.toPandas()
    assert len(got) == whitened.size and (got["n"] == len(ids)).all()
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1
    for c in range(whitened.shape[1]):
        mine = got[got["component"] == c + 1].set_index("vec_id")
        values = mine.loc[ids, "whitened"].to_numpy()
        sign = np.sign(values @ whitened[:, c])
        assert np.allclose(values * sign, whitened[:, c], atol=1e-8)
        assert np.allclose(mine["explained"], explained[c], rtol=1e-10)
        assert (mine.loc[ids, "deviation"].to_numpy() == deviation).all()


def test_whitened_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(90, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 11, [1.0] * 13, [None] * 12, [nan] + [0.0] * 11, [0.0] * 11 + [-inf], [1e30] + [0.0] * 11]
    rows = [(i, [float(c) for c in v], 0, 1, "x") for i, v in enumerate(good)] + [(1000 + i, v, 0, 1, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int, n int, x string").repartition(11)
    compare(whitening.whitened(df), list(range(90)), good)


def test_repeated_rows_and_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 2.0]), (None, None)]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    # three vectors on a line: one component
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert got[0].explained == pytest.approx(1)
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]):
        assert whitening.whitened(spark.createDataFrame(few, schema)).count() == 0


def test_deviation_beyond_a_long_is_missing(spark):
    rows = [(i, [float(2**40 * (i % 2)), float(i)]) for i in range(6)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None for r in got)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter(F.col("embedding").isNotNull()).collect()
    whole = [r for r in rows if all(c is not None and np.isfinite(c) for c in r.embedding)]
    compare(queries.QUERIES["op12_whitened_embeddings"](spark, "/root/testdata/sf0.001"), [r.vec_id for r in whole], [r.embedding for r in whole])
