"""Warped neighbours against all alignments."""

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from passerine.operators import elastic

SCHEMA = "id long, v array<double>, q_id string"


def slow(x, y, band):
    n = len(x)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            if abs(i - j) <= band:
                d[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, n]


def test_alignment_and_its_bounds():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(40, 9)).cumsum(axis=1), draw.normal(size=(40, 9)).cumsum(axis=1)
    for band in (0, 1, 3, 9):
        got = elastic.warped(x, y, band)
        assert got == pytest.approx([slow(a, b, band) for a, b in zip(x, y)])
        box = elastic.outside(y, *elastic.envelope(x, band))
        assert (np.diag(box) <= got + 1e-9).all() and (got <= ((x - y) ** 2).sum(axis=1) + 1e-9).all()
    assert elastic.warped(x, y, 0) == pytest.approx(((x - y) ** 2).sum(axis=1))


@pytest.mark.parametrize("n", [300, 6000])
def test_nearest_equal_all_alignments(spark, n):
    draw = np.random.default_rng(n)
    shapes = draw.normal(size=(30, 8)).cumsum(axis=1) * 3
    v = np.round(shapes[draw.integers(0, 30, n)] + draw.normal(size=(n, 8)) * 0.1, 3)
    v[:4] = v[4]
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], SCHEMA)
    asked, seen = df.where(F.col("id") % (1 if n < 1000 else 40) == 0), Observation()
    got = elastic.nearest(asked, df, "id", "v", 8, 2, 3, seen).collect()
    tried = {}
    for r in got:
        tried[r["q_id"]] = r["compared"]
    for q in tried:
        cost = np.round(elastic.warped(np.repeat(v[q : q + 1], n, axis=0), v, 2), 6)
        cost[q] = np.inf
        want = sorted((c, i) for i, c in enumerate(cost))[:3]
        assert [(r["d2"], r["id"]) for r in sorted(got, key=lambda r: r["nn_rank"]) if r["q_id"] == q] == [(pytest.approx(c), i) for c, i in want]
    assert len(tried) == asked.count()
    # of 30 shapes a query is aligned with less than a tenth of all rows
    assert sum(tried.values()) < 0.1 * n * len(tried)


def test_awkward_contours(spark):
    rows = [(1, [0.0, 1.0], ""), (2, [0.0, 1.0], ""), (3, None, ""), (4, [1.0], ""), (5, [None, 1.0], ""), (6, [float("nan"), 1.0], ""), (None, [0.0, 1.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r)[:4] for r in elastic.nearest(df, df, "id", "v", 2, 1, 5).collect()) == [(1, 2, 0.0, 1), (2, 1, 0.0, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert elastic.nearest(df, empty, "id", "v", 2, 1).count() == 0
    assert elastic.nearest(empty, df, "id", "v", 2, 1).count() == 0


def test_resampled(spark):
    df = spark.createDataFrame([([0.0, 2.0, 4.0],), ([5.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(elastic.resampled(F.col("v"), 5)).collect()] == [[0.0, 1.0, 2.0, 3.0, 4.0], [5.0] * 5, None, None]
