"""File sources and writers on small files."""

import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from passerine.sources import files, tables

HEAD = "audio_id,model,common_name,confidence,start_time,end_time"


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    for folder, name, text in (
        ("a/Output", "2.csv", f'﻿{HEAD}\r\nr1,WingNet,"Tit, great",0.9,0,3\r\nr1, wingnet ,"He said ""hi""\nthere",0.9,0,3\r\n'),
        ("b/output", "1.csv", f"{HEAD}\nr1,WINGNET,Wren,0.7,3,6\nr2,other,Wren,0.99,0,3\nr2,wingnet,Wren,NaN,0,3\nr2,wingnet,Wren,,0,3\nlonely\nr2,wingnet,Wren\nr2,wingnet,Robin,0.5,0,3\n\nr3,wingnet,Owl,0.51,9,12\n"),
        ("b/else", "3.csv", f"{HEAD}\nr9,wingnet,Crow,0.9,0,3\n"),
    ):
        (top / folder).mkdir(parents=True, exist_ok=True)
        (top / folder / name).write_text(text, newline="")
    return top


def test_csv(spark, logs):
    rows = files.read_csv(spark, str(logs), recursive=True, folder="output").collect()
    got = sorted((r["audio_id"], r["model"], r["common_name"], r["confidence"]) for r in rows)
    assert ("r1", "WingNet", "Tit, great", "0.9") in got and ("r1", " wingnet ", 'He said "hi"\nthere', "0.9") in got
    assert ("r2", "wingnet", "Wren", "") in got and not any(r[0] in ("lonely", "r9") for r in got) and len(got) == 9


def test_manifest(spark, logs, tmp_path):
    rows = files.read_csv(spark, str(logs), recursive=True, folder="output")
    m = files.manifest(rows, "wingnet", ["audio_id", "start_time", "end_time"], ["source_csv", "source_row"])
    best = {(r["audio_id"], r["start_time"]): r["common_name"] for r in m.collect()}
    assert best == {("r1", "0"): "Tit, great", ("r1", "3"): "Wren", ("r3", "9"): "Owl"}
    paths = spark.createDataFrame([("x/r1.wav",), ("y/r1.WAV",), ("z\\r3.wav",)], "path string")
    joined = files.with_audio(m, files.basename_index(paths)).select("audio_id", "local_audio_path").distinct().collect()
    assert {tuple(r) for r in joined} == {("r1", "y/r1.WAV"), ("r3", "z\\r3.wav")}
    out = str(tmp_path / "m")
    files.write_csv(m, out, ["audio_id", "common_name", "confidence"], [F.col("audio_id"), F.col("start_time")])
    again = files.read_csv(spark, out).orderBy("source_row").collect()
    assert [(r["audio_id"], r["common_name"]) for r in again] == [("r1", "Tit, great"), ("r1", "Wren"), ("r3", "Owl")]
    seen, watch = files.counted(rows, rows=F.count(F.lit(1)), eligible=F.count_if(files.eligible("wingnet")))
    seen.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 9, "eligible": 4}


def test_documents(spark, tmp_path):
    schema = "id string, kind string"
    assert files.read_registry(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text("[{")
    assert files.read_registry(spark, str(tmp_path / "bad.json"), schema).count() == 0
    (tmp_path / "good.json").write_text(json.dumps([{"id": "a", "kind": "k"}, {"id": "b", "kind": "l"}], indent=2))
    assert files.read_registry(spark, str(tmp_path / "good.json"), schema).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"features": [[1, 2], [3, 4]]}, indent=1))
    assert files.read_document(spark, str(tmp_path / "m.json"), "features array<array<double>>").first()[0] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "labels.txt").write_text("Parus major_Great Tit\r\nNoise\r\n\nA b_C d_E\n")
    assert [tuple(r) for r in tables.labels(spark, str(tmp_path / "labels.txt")).orderBy("id").collect()] == [(0, "Parus major", "Great Tit"), (1, "Noise", "Noise"), (2, "A b", "C d")]
    df = spark.range(3)
    files.write_once(df, str(tmp_path / "once"))
    files.write_once(spark.range(9), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3
    assert files.argument(["--a=1", "--b=x=y", "--b=z"], "b", "n") == "x=y" and files.argument([], "b", "n") == "n"
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("sample", 3)], "id string, n int")
    pick = lambda want: files.preferred(rows, [F.col("id") == want, F.col("id") == "sample", F.lit(True)], ["n"]).first()["id"]
    assert pick("a") == "a" and pick("zz") == "sample"
    assert files.preferred(rows.where("n < 3"), [F.col("id") == "zz", F.col("id") == "sample", F.lit(True)], ["n"]).first()["id"] == "b"


def _wav(path, x, rate, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes((np.repeat(x, channels) * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes())


def test_audio(spark, tmp_path):
    t = np.arange(16000) / 8000
    x = np.sin(2 * math.pi * 100 * t) * 0.5
    (tmp_path / "d").mkdir()
    _wav(tmp_path / "d" / "one.wav", x, 8000, channels=2)
    _wav(tmp_path / "two.WAV", x[:4000], 8000, width=4)
    whole = {r["audio_id"]: np.array(r["samples"]) for r in files.read_audio(spark, str(tmp_path), 8000).collect()}
    assert np.allclose(whole["one"], x, atol=1e-3) and len(whole["two"]) == 4000
    twice = {r["audio_id"]: np.array(r["samples"]) for r in files.read_audio(spark, str(tmp_path), 16000).collect()}
    assert len(twice["one"]) == 32000 and np.allclose(twice["one"][::2], x, atol=1e-3)
    windows = spark.createDataFrame([("one", 0.5, 0.6, 7), ("two", 0.25, 2.0, 8), ("three", 0.0, 1.0, 9)], "audio_id string, start double, end double, n int")
    cut = {r["n"]: np.array(r["samples"]) for r in files.read_audio(spark, str(tmp_path), 8000, windows).collect()}
    assert set(cut) == {7, 8} and len(cut[7]) == 8000 and np.allclose(cut[7], x[4000:12000], atol=1e-3)
    assert len(cut[8]) == 14000 and np.allclose(cut[8][:2000], x[2000:4000], atol=1e-3) and not cut[8][2000:].any()
    assert files.file_paths(spark, str(tmp_path), "*.wav", F.col("path").contains("/d/")).count() == 1


def test_one_document(spark, tmp_path):
    rows = [(3, "b\n", [1.5, None]), (1, 'a"', []), (2, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, v array<double>").repartition(3)
    path = f"{tmp_path}/out.json"
    for _ in range(2):  # the second one takes the place of the first
        tables.write_document(df, path, [F.col("id")])
        assert json.load(open(path)) == [{"id": 1, "name": 'a"', "v": []}, {"id": 2}, {"id": 3, "name": "b\n", "v": [1.5, None]}]
        assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.json"]
    back = files.read_document(spark, path, "id long, name string, v array<double>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tables.write_document(df.where("id = 1").withColumn("more", F.struct("id", "v")), path, single=True)
    assert json.load(open(path)) == {"id": 1, "name": 'a"', "v": [], "more": {"id": 1, "v": []}}
    assert "\n" in open(path).read().strip()
    tables.write_document(df.limit(0), path)
    assert json.load(open(path)) == []
    with pytest.raises(ValueError):
        tables.write_document(df, path, single=True)
