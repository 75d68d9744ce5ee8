"""Queries on recordings and tables longer than those of the test data, against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation, functions as F
from test_queries import plain

from passerine import catalog
from passerine.operators import metric_index, vectors


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """A recording of 1,500 frames and one of 20."""
    to = str(tmp_path_factory.mktemp("long"))
    x = np.random.default_rng(3).normal(size=(1520, 64))
    rows = [(i, v.tolist(), int(i % 76 == 0)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{to}/embeddings.parquet")
    return to


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    df, want = catalog.queries()[name](spark, folder), con.sql(catalog.oracle_sql()[name])
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["point_grid", "louder_points", "visual_channels"])
def test_points_of_a_long_recording(spark, long, name):
    same_as_sql(spark, long, name)


@pytest.mark.parametrize("name", ["time_gap_edges", "edge_endpoints"])
def test_edges_of_a_long_recording(spark, long, name, monkeypatch):
    """The SQL's rows, from few of the pairs of a recording."""
    for limit, n in (("PER_PIVOT", 40), ("PER_RING", 20), ("BLOCK", 50)):
        monkeypatch.setattr(metric_index, limit, n)
    same_as_sql(spark, long, name)


def test_edges_take_few_pairs(spark, monkeypatch):
    """Points of two keys, with ties and short gaps: exact, and a tenth of all pairs of a key at most is looked at."""
    for limit, n in (("PER_PIVOT", 40), ("PER_RING", 20), ("BLOCK", 50)):
        monkeypatch.setattr(metric_index, limit, n)
    rng, seen = np.random.default_rng(5), Observation()
    x, t, key = np.round(rng.normal(size=(3000, 2)), 2), rng.integers(0, 900, 3000) * 0.5, rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(f"k{k}", i, float(u), v.tolist()) for i, (k, u, v) in enumerate(zip(key, t, x, strict=True))], "k string, i long, t double, v array<double>")
    want = set()
    for i in range(3000):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        d[(key != key[i]) | (np.abs(t - t[i]) < 1.5) | (np.arange(3000) == i)] = np.inf
        want |= {(f"k{key[i]}", min(i, int(j)), max(i, int(j)), float(d[j])) for j in np.argsort(d, kind="stable")[:3]}
    nearest = metric_index.nearest
    monkeypatch.setattr(metric_index, "nearest", lambda index, q, a, b, k, _, *more: nearest(index, q, a, b, k, seen, *more))
    assert {tuple(r) for r in vectors.time_gap_edges(df, "k", "i", "t", F.col("v"), 1.5, 3).collect()} == want
    assert seen.get["visits"] * 20 < 3000 * 3000 / 2 / 3
