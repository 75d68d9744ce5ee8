"""Vector and signal operators that SQL can't express, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from passerine.operators import matrix, signal

SCHEMA = "id long, v array<double>"


def rows(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], SCHEMA)


def test_principal_components(spark):
    x = np.random.default_rng(1).normal(size=(40, 5)) @ np.random.default_rng(2).normal(size=(5, 5))
    got, share, loadings = matrix.principal_components(rows(spark, x), "v", 5, 3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(share, (values / values.sum())[:3])
    scores = np.array([r.v for r in got.orderBy("id").collect()])
    assert np.allclose(scores, z @ loadings)
    assert np.allclose((scores**2).sum(axis=0), values[:3])


def test_target_share(spark):
    x = np.random.default_rng(3).normal(size=(60, 6))
    _, share, _ = matrix.principal_components(rows(spark, x), "v", 6)
    assert sum(share) >= 0.95 > sum(share[:-1])


def test_perfect_embedding(spark):
    x = np.random.default_rng(4).normal(size=(20, 4))
    got = matrix.trustworthiness(rows(spark, x), "id", F.col("v"), F.col("v")).first()[0]
    assert got == 1.0


def test_cepstrum(spark):
    t = np.arange(512) / 16000
    frames = [np.sin(2 * np.pi * 1000 * t), np.zeros(512)]
    got = signal.magnitudes(rows(spark, frames), "v").orderBy("id").collect()
    assert int(np.argmax(got[0].magnitude)) == 32 and not any(got[1].magnitude)
    coefficients = signal.mfcc(rows(spark, frames), "v", 16000.0).orderBy("id").collect()
    assert len(coefficients[0].mfcc) == 13
    assert np.isclose(coefficients[1].mfcc[0], 26 * np.log(1e-12)) and np.allclose(coefficients[1].mfcc[1:], 0, atol=1e-9)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None)], SCHEMA)
    assert signal.magnitudes(df, "v").count() == 0
    assert signal.mfcc(df.where("false"), "v", 16000.0).count() == 0


def test_pitch_class(spark):
    got = spark.createDataFrame([(440.0,), (880.0,), (466.16,), (415.3,)], "f double").select(signal.pitch_class(F.col("f"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 11]


def test_components_of_many_dimensions(spark):
    """15,677 dimensions: as many components as explain 95 %, and more than 128 if asked for."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 12)) @ rng.normal(size=(12, 15_677)) + rng.normal(size=(150, 15_677)) * 0.3
    df = rows(spark, x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    want = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    got, share, loadings = matrix.principal_components(df, "v", 15_677)
    assert len(share) == want and np.allclose(share, (values / values.sum())[:want], atol=1e-8)
    scores = np.array([r.v for r in got.orderBy("id").collect()])
    assert np.allclose(scores, z @ loadings) and np.allclose((scores**2).sum(axis=0), values[:want], rtol=1e-5)
    flat = rng.normal(size=(200, 600))
    share = matrix.principal_components(rows(spark, flat), "v", 600, 140)[1]
    exact = np.linalg.svd((flat - flat.mean(axis=0)) / flat.std(axis=0), compute_uv=False) ** 2
    assert len(share) == 140 and np.allclose(share, (exact / exact.sum())[:140], rtol=1e-3)


def test_standard_scores_with_null_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, None), (2, [3.0, 5.0])], SCHEMA)
    assert [r.v for r in matrix.standardised(df, "v", 2).orderBy("id").collect()] == [[-1.0, 0.0], None, [1.0, 0.0]]
    assert matrix.moments(df.where("id = 1"), "v", 2) == ([0.0, 0.0], [1.0, 1.0])
