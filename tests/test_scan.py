"""Segmented scans against plain loops: one long key, null keys, ties."""

import random

import pytest
from pyspark.sql import functions as F

from passerine.operators import scan, sequence


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [("long", k // 3, k, rng.random() < 0.4, rng.choice([None, rng.randrange(99)])) for k in range(3000)]
    return out + [(None, k, k, k % 5 == 0, k) for k in range(40)] + [("one", 7, 1, True, None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, n long, on boolean, x long").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("segments", [1, 7, 200])
def test_scans_by_loops(table, rows, segments):
    cut = scan.segmented(table, "t", segments=segments)
    assert segments == 1 or cut.select("_seg").distinct().count() > segments // 2
    got = scan.running_sum(cut, ["key"], ["t", "n"], F.col("x"), "sum")
    got = scan.last_value(got, ["key"], ["t", "n"], F.col("x"), "before")
    got = scan.last_value(got, ["key"], ["t", "n"], F.col("x"), "upto", own=True)
    got = scan.next_value(got, ["key"], ["t", "n"], F.col("x"), "after")
    got = {(r["key"], r["n"]): (r["sum"], r["before"], r["upto"], r["after"]) for r in got.collect()}
    assert len(got) == len(rows)
    for key, own in by_key(rows).items():
        total, last = 0, None
        for k, (_, _, n, _, x) in enumerate(own):
            total, before, last = total + (x or 0), last, x if x is not None else last
            after = next((r[4] for r in own[k + 1 :] if r[4] is not None), None)
            assert got[key, n] == (total, before, last, after)


def test_islands_of_one_long_key(table, rows):
    got = {(r["key"], r["first_row"], r["last_row"]) for r in sequence.islands(table, "key", "n", "t", F.col("on"), 2, 2).collect()}
    want = set()
    for key, own in by_key(rows).items():
        runs, at = [], [k + 1 for k, r in enumerate(own) if r[3]]
        for k in at:
            if runs and k - runs[-1][1] - 1 <= 2:
                runs[-1][1] = k
            else:
                runs.append([1 if not runs and k - 1 <= 2 else k, k])
        want |= {(key, a, b) for a, b in runs if b - a + 1 >= 2}
    assert got == want and len(want) > 100


def test_a_long_key_is_in_many_tasks(spark):
    """A million frames of one recording: no task of a window has more than a few segments."""
    frames = spark.range(1_000_000).select(F.lit("r").alias("key"), "id", (F.col("id") / 100).alias("t"), (F.col("id") % 1000 < 900).alias("on"))
    sizes = scan.segmented(frames, "t").groupBy("_seg").count().agg(F.max("count"), F.count("count")).first()
    assert sizes[0] < 3 * 1_000_000 / scan.SEGMENTS and sizes[1] == scan.SEGMENTS
    assert sequence.islands(frames, "key", "id", "t", F.col("on"), 5, 2).count() == 1000


def test_no_rows(table):
    assert sequence.islands(table.where("false"), "key", "n", "t", F.col("on"), 2, 2).collect() == []
