"""Silhouettes, agreement and densities against brute force."""

import math
import random

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from passerine.operators import clusters

SCHEMA = "id long, c string, v array<double>, own string"


def groups(spark, n=120, seed=3):
    draw = random.Random(seed)
    rows = [(i, f"g{i % 3}", [draw.gauss(3 * (i % 3), 1), draw.gauss(0, 1)], "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_silhouettes_equal_all_pairs(spark):
    rows, df = groups(spark)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    got = {r["id"]: r for r in clusters.silhouettes(df, "id", "c", "v").collect()}
    for i, c, v, _ in rows:
        means = {k: [far(v, w) for j, d, w, _ in rows if d == k and j != i] for k in ("g0", "g1", "g2")}
        a, b = sum(means[c]) / len(means[c]), min(sum(m) / len(m) for k, m in means.items() if k != c)
        assert got[i]["silhouette"] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    ready = df.select(F.regexp_extract("c", r"\d", 0).cast("int").alias("prediction"), array_to_vector("v").alias("features"))
    mean = sum(r["silhouette"] for r in got.values()) / len(got)
    assert mean == pytest.approx(ClusteringEvaluator().evaluate(ready), abs=1e-9)


def test_silhouettes_of_awkward_rows(spark):
    rows = [(1, "a", [0.0], ""), (2, "a", [0.0], ""), (3, "b", [2.0], ""), (4, None, [1.0], ""), (5, "b", None, ""), (6, "b", [None], ""), (7, "a", [], ""), (None, "a", [0.0], "")]
    got = {r["id"]: (r["own"], r["other"], r["silhouette"]) for r in clusters.silhouettes(spark.createDataFrame(rows, SCHEMA), "id", "c", "v").collect()}
    assert got == {1: (0.0, 4.0, 1.0), 2: (0.0, 4.0, 1.0), None: (0.0, 4.0, 1.0), 3: (0.0, 4.0, 0.0)}
    one = clusters.silhouettes(spark.createDataFrame(rows[:2], SCHEMA), "id", "c", "v")
    assert [r["silhouette"] for r in one.collect()] == [None, None]
    assert clusters.silhouettes(spark.createDataFrame([], SCHEMA), "id", "c", "v").count() == 0


def test_agreement(spark):
    make = lambda rows: clusters.adjusted_rand(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert tuple(make([("x", "1"), ("x", "1"), ("y", "2"), ("y", "2"), (None, "2")])) == (4, 1.0)
    # by hand: contingency 2 1 / 1 2, so 2 pairs agree, 6 a side, 15 in all
    six = [("x", "1"), ("x", "1"), ("x", "2"), ("y", "1"), ("y", "2"), ("y", "2")]
    assert make(six)["adjusted_rand"] == pytest.approx((2 - 36 / 15) / (6 - 36 / 15))
    assert tuple(make([])) == (0, 1.0)
    assert make([("x", "1")])["adjusted_rand"] == 1.0


@pytest.mark.parametrize("axes", ["x", "xy", "xyz"])
def test_density_is_within_its_bound(spark, axes):
    draw = random.Random(len(axes))
    points = [tuple(draw.choice([0.0, 1.0]) + draw.gauss(0, 0.3) for _ in axes) for _ in range(200)] + [(0.1,) * len(axes)] * 50
    df = spark.createDataFrame([("g", *p) for p in points], "k string, " + ", ".join(f"{a} double" for a in axes))
    df = df.unionByName(spark.createDataFrame([("g", *[float("nan")] * len(axes)), (None, *[1.0] * len(axes))], df.schema))
    found = clusters.density(df, ["k"], axes, 0.25).collect()
    norm = (2 * math.pi) ** (len(axes) / 2) * 0.25 ** len(axes)
    alone = 0
    for r in found:
        at = [r[f"n_{a}"] * 0.25 for a in axes]
        here = points if r["k"] == "g" else [(1.0,) * len(axes)]
        true = sum(math.exp(-sum((x - y) ** 2 for x, y in zip(p, at)) / 0.125) for p in here) / (len(here) * norm)
        assert abs(true - r["density"]) <= r["bound"] + 1e-12
        alone += r["k"] is None
    assert alone and max(r["bound"] for r in found) < 0.05 * max(r["density"] for r in found)
