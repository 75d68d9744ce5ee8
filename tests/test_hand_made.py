"""Operators on hand-made rows: nothing is lost, ties and flat inputs are defined."""

import numpy as np
from pyspark.sql import functions as F

from passerine.functions import scalar
from passerine.operators import experiments, frames, matrix, metric_index, select, sequence


def test_interval_join_keeps_every_point(spark):
    points = spark.createDataFrame([("u", 10), ("u", 5000), ("v", 3), ("u", 2), ("u", 2)], "k string, at int")
    spans = spark.createDataFrame([("u", 0, 5, 9), ("u", 1, 4, 8), ("u", 7, 7, 1)], "k string, a int, b int, id int")
    got = sorted(map(tuple, sequence.interval_join(points, spans, "k", "at", "a", "b", 4, "id").select("k", "at", "id").collect()), key=repr)
    assert got == sorted([("u", 10, None), ("u", 5000, None), ("v", 3, None), ("u", 2, 8), ("u", 2, 8)], key=repr)


def test_asof_ties_and_lines(spark):
    right = spark.createDataFrame([("u", 1, 10.0, 1), ("u", 1, 20.0, 2), ("u", 5, 40.0, 3)], "k string, t int, x double, id int")
    left = spark.createDataFrame([("u", 0), ("u", 1), ("u", 3), ("u", 9)], "k string, t int")
    assert [r["x"] for r in sequence.asof(left, right, "k", "t", "x", "id").orderBy("t").collect()] == [None, 20.0, 20.0, 40.0]
    assert [r["x"] for r in sequence.interpolated(left, right, "k", "t", "x", "id").orderBy("t").collect()] == [None, 20.0, 30.0, 40.0]


def test_nearest_ranks(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501) * 10.0 ** rng.integers(-8, 8, 501), "b": np.repeat([1.5, -2.0, 0.0], 100), "c": np.array([7.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("b", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in select.nearest_ranks(df, ["k"], "v", {"p0": 0.0, "p2": 0.2, "p85": 0.85, "p1": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert [got[k][n] for n in ("p0", "p2", "p85", "p1")] == [float(np.sort(v)[int(q * (len(v) - 1))]) for q in (0, 0.2, 0.85, 1)]


def test_best_by_takes_text_ties_and_nulls(spark):
    df = spark.createDataFrame([("k", 1.0, "b"), ("k", 1.0, "a"), ("k", None, "0"), ("n", None, "z")], "k string, v double, t string")
    assert {tuple(r) for r in select.best_by(df, ["k"], "v", ["t"]).collect()} == {("k", 1.0, "a"), ("n", None, "z")}


def test_scalars(spark):
    df = spark.createDataFrame([(-2.5, 1.005), (2.5, 0.0)], "a double, b double")
    assert [tuple(r) for r in df.select(scalar.half_up(F.col("a")), scalar.half_up(F.col("b"), 2)).collect()] == [(-2.0, 1.0), (3.0, 0.0)]
    assert df.select(scalar.unit_range(F.col("a"), F.lit(1.0), F.lit(1.0)).alias("x")).first()["x"] == 0.5
    one = spark.createDataFrame([([0.0] * 12, [0.0] * 7 + [3.0] + [0.0, 0.0, 0.1, 0.0])], "quiet array<double>, loud array<double>")
    out = one.select(*scalar.triad(F.col("quiet")), *scalar.triad(F.col("loud"))).first()
    assert tuple(out) == ("—", "—", "G", "D# maj")


def test_draws_jump():
    s, want = 123456789, []
    for _ in range(50):
        s = (1664525 * s + 1013904223) % 2**32
        want.append(s / 2**32)
    assert experiments.draws(123456789, 0, 50).tolist() == want and experiments.draws(123456789, 30, 5).tolist() == want[30:35]


def test_permutations_in_one_stream(spark):
    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(12, 3)), [0] * 6 + [1] * 6
    x[6:] += 0.8
    df = spark.createDataFrame([(i, int(l), [float(a) for a in v]) for i, (l, v) in enumerate(zip(labels, x))], "id long, l int, v array<double>").repartition(3)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def delta(l):
        pairs = [(apart[i, j], l[i] == l[j]) for i in range(12) for j in range(i + 1, 12)]
        return np.mean([d for d, s in pairs if not s]) - np.mean([d for d, s in pairs if s])

    s, n = 77, 0
    for _ in range(40):
        l = list(labels)
        for i in range(11, 0, -1):
            s = (1664525 * s + 1013904223) % 2**32
            j = int(s / 2**32 * (i + 1))
            l[i], l[j] = l[j], l[i]
        n += delta(l) >= delta(labels)
    got = experiments.permutation_test(df, "id", "l", "v", 40, 77).first()
    assert (got["permutations"], got["at_least"], got["p_value"]) == (40, n, (n + 1) / 41) and abs(got["observed"] - delta(labels)) < 1e-9


def _trust(o, e, k):
    n, late = len(o), 0
    for i in range(n):
        rank = lambda m: [int(j) for j in np.lexsort((np.arange(n), np.round(((m - m[i]) ** 2).sum(axis=1), 6))) if j != i]
        ro, re_ = rank(o), rank(e)
        late += sum(max(ro.index(j) + 1 - k, 0) for j in re_[:k])
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * late


def test_evaluation(spark, monkeypatch):
    for name, n in (("PER_PIVOT", 16), ("PER_RING", 8), ("BLOCK", 20)):
        monkeypatch.setattr(metric_index, name, n)
    x = np.random.default_rng(5).normal(size=(50, 6)) @ np.random.default_rng(6).normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    got = experiments.evaluate(df, "id", "v", 6, 9).first()
    assert abs(got["real"] - _trust(z, u[:, :3] * s[:3], 5)) < 1e-6
    assert got["passed"] == (got["margin"] >= 0.02) and got["rows"] == 50
    rows = spark.createDataFrame([("a", 0.9, True), ("b", 0.885, True), ("c", 0.99, False), ("d", 0.8, True)], "n string, s double, p boolean")
    assert {r["n"] for r in experiments.carried(rows, "s", "p").collect()} == {"a", "b"}
    assert experiments.carried(rows.where("not p"), "s", "p").count() == 0


def test_components_of_many_dimensions(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(30, 4)) @ np.random.default_rng(3).normal(size=(4, 40)) + 0.01 * np.random.default_rng(4).normal(size=(30, 40))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    dense = matrix.principal_components(df, "v", 40, 3)
    monkeypatch.setattr(matrix, "DENSE", 10)
    wide = matrix.principal_components(df, "v", 40, 3)
    assert np.allclose(dense[1], wide[1], atol=1e-6) and np.allclose(dense[2], wide[2], atol=1e-5)
    placed = experiments.shared_space(df, "v", 40).collect()
    assert abs(max(abs(a) for r in placed for a in r["v"]) - 10) < 1e-9 and all(len(r["v"]) == 3 for r in placed)


def test_ellipsoid_and_cards(spark):
    x = np.random.default_rng(8).normal(size=(20, 3)) @ np.diag([3, 1, 0.2])
    rows = [("a", *map(float, v)) for v in x] + [("b", 0.0, 0.0, 0.0)] * 3
    (e,) = matrix.ellipsoids(spark.createDataFrame(rows, "k string, x double, y double, z double"), "k", ("x", "y", "z")).collect()
    m = np.array(e["matrix"]).reshape(4, 4).T
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.cov(x.T, bias=True) * 1.6**2) and np.allclose(m[:3, 3], x.mean(axis=0)) and e["radii"] == sorted(e["radii"])
    members = spark.createDataFrame([(1, "p", 0.5, 0.0), (2, "p", 0.9, 4.0), (3, "p", 0.9, 1.0)], "id int, category string, c double, x double")
    cards = {r["category"]: r for r in matrix.category_rollup(members, ["p", "q"], "id", "c", ["x"]).collect()}
    assert (cards["p"]["n"], cards["p"]["members"], cards["p"]["representative"]) == (3, ["2", "3", "1"], 3)
    assert (cards["q"]["n"], cards["q"]["members"], cards["q"]["mean_confidence"], cards["q"]["representative"]) == (0, [], 0.0, None)


def test_silent_and_short_recordings(spark):
    rows = [("s", i, [0.0] * 8, [0.0] * 8) for i in range(5)] + [("t", 0, [1.0] + [0.0] * 7, [0.5] * 8)]
    f = spark.createDataFrame(rows, "rec string, i long, s array<double>, x array<double>")
    assert {r["rec"]: (r["ht"], r["hf"]) for r in frames.acoustic_entropy(f).collect()} == {"s": (0.0, 0.0), "t": (0.0, 0.0)}
    d = frames.described(f, 100.0)
    assert frames.syllables(d, 0.02).count() == 0
    assert all(r["count"] == 0 and r["mean_gap"] == 0 for r in frames.syllable_summary(frames.syllables(d, 0.02), f, 0.02).collect())
    assert frames.complexity(f, 2).where("rec = 't'").count() == 0 and frames.complexity(f, 2).where("rec = 's' and cluster = 2").count() == 0
    assert frames.point_grid(f, 100.0, 0.02).count() == 0 and frames.framed(f, "x", 9, 1).count() == 0
    assert frames.summary_features(f, 100.0, 8, 0.02).count() == 2
