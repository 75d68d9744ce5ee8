"""Streams give what the batch operators give, whatever the order of the files."""

import random

import pytest
from pyspark.sql import functions as F

from passerine.operators import select
from passerine.streaming import changelog, keyed

SCHEMA = "k long, t timestamp, v double, id long"
ISLANDS = f"k bigint, {keyed.ISLAND}"


def rows_of(seed: int, n: int = 300):
    draw = random.Random(seed)
    rows = [(draw.choice([None, 1, 2, 3]), draw.randrange(4000), draw.choice([None, 1.0, 2.0, float(draw.randrange(9))]), i) for i in range(n)]
    return rows + [(1, None, 5.0, n)]


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, s long, v double, id long").select("k", F.timestamp_seconds("s").alias("t"), "v", "id")


def in_files(spark, rows, folder, order):
    """One file for each part of the rows, named and dated in the order they are read."""
    import os

    for place, part in enumerate(order):
        out = f"{folder}/{place}"
        batch(spark, rows[part :: len(order)]).coalesce(1).write.parquet(out)
        for name in os.listdir(out):
            if name.endswith(".parquet"):
                os.rename(f"{out}/{name}", f"{folder}/{place}.parquet")
                os.utime(f"{folder}/{place}.parquet", (1_000_000 + place, 1_000_000 + place))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def run(changes, folder):
    changelog.started(changes, f"{folder}/out", f"{folder}/state").awaitTermination()
    return f"{folder}/out"


def by_hand(rows, gap):
    """Islands of active rows by a loop."""
    out = []
    for key in {r[0] for r in rows}:
        on = sorted(((s * 1_000_000, v) for k, s, v, _ in rows if k == key and s is not None), key=lambda r: r[0])
        for t, v in on:
            if not out or out[-1][0] != key or t - out[-1][2] > gap * 1_000_000:
                out.append([key, t, t, 0, None])
            o = out[-1]
            o[2], o[3], o[4] = t, o[3] + 1, v if o[4] is None else o[4] if v is None else max(v, o[4])
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 0, 2, 1]])
def test_any_order_of_files_equals_batch(spark, tmp_path, order):
    rows = rows_of(5)
    source = in_files(spark, rows, tmp_path / "in", order)
    best = keyed.best_per_window(source, ["k"], "t", "5 minutes", "v", ["id"])
    kept = keyed.best_kept(spark, run(best, tmp_path / "best"), "k long, start timestamp, t timestamp, v double, id long", ["k"])
    want = select.best_by(batch(spark, rows).where("t is not null").withColumn("start", F.window("t", "5 minutes")["start"]), ["k", "start"], "v", ["id"])
    assert sorted(map(repr, kept.select("k", "start", "t", "v", "id").collect())) == sorted(map(repr, want.select("k", "start", "t", "v", "id").collect()))

    found = keyed.islands(source, "k", "t", "v", F.lit(True), 30)
    got = keyed.islands_kept(spark, run(found, tmp_path / "islands"), "k", "bigint")
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == by_hand(rows, 30)


def test_timers_close_islands_and_late_rows_go(spark, tmp_path):
    rows = [(1, 10, 1.0, 0), (1, 20, 3.0, 1), (2, 15, 2.0, 2)], [(3, 1000, 1.0, 3)], [(3, 1005, 2.0, 6)], [(1, 25, 9.0, 4), (3, 1010, 4.0, 5)]
    for place, part in enumerate(rows):
        in_files(spark, list(part), tmp_path / f"p{place}", [0])
    import os

    os.makedirs(tmp_path / "in")
    for place in range(4):  # Spark drops what is behind the mark of the batch before
        os.rename(tmp_path / f"p{place}" / "0.parquet", tmp_path / "in" / f"{place}.parquet")
        os.utime(tmp_path / "in" / f"{place}.parquet", (1_000_000 + place,) * 2)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    found = keyed.islands(source, "k", "t", "v", F.lit(True), 10, "60 seconds")
    got = keyed.islands_kept(spark, run(found, tmp_path), "k", "bigint")
    assert sorted(map(tuple, got.collect())) == [
        (1, 10_000_000, 20_000_000, 2, 3.0, False), (2, 15_000_000, 15_000_000, 1, 2.0, False), (3, 1_000_000_000, 1_010_000_000, 3, 4.0, True),
    ]


def test_batches_count_once_and_unfinished_ones_not_at_all(spark, tmp_path):
    import os

    path, schema = f"{tmp_path}/log", "k long, v string"
    write = changelog.appended(path)
    first, second = spark.createDataFrame([(1, "a"), (None, "b")], schema), spark.createDataFrame([(1, "c"), (2, "d")], schema)
    assert changelog.changes(spark, path, schema).count() == 0
    write(first, 0), write(second, 1), write(second, 1)
    want = [(1, "c"), (2, "d"), (None, "b")]
    now = lambda: sorted(map(tuple, changelog.latest(changelog.changes(spark, path, schema), ["k"]).select("k", "v").collect()), key=repr)
    assert now() == want
    write(spark.createDataFrame([(1, "lost")], schema), 2)
    os.remove(f"{path}/batch-{2:019d}/_SUCCESS")
    assert now() == want
    assert changelog.compacted(spark, path, schema, lambda c: changelog.latest(c, ["k"])) == 2
    assert now() == want and changelog.changes(spark, path, schema).count() == 3
    write(spark.createDataFrame([(1, "e")], schema), 2)
    assert now() == [(1, "e"), (2, "d"), (None, "b")]


def test_empty_stream(spark, tmp_path):
    source = in_files(spark, [(1, None, 1.0, 0)], tmp_path / "in", [0])
    found = keyed.islands(source, "k", "t", "v", F.lit(True), 30)
    assert keyed.islands_kept(spark, run(found, tmp_path / "o"), "k", "bigint").count() == 0
