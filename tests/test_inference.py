"""The classifier hook with a small model."""

import numpy as np

from passerine.operators import inference


def test_chunks_and_detections(spark):
    def load():  # defined here, so that workers get it by value
        import numpy as np

        return lambda chunks: np.stack([np.abs(chunks).mean(axis=1) * 4 - 2, chunks[:, 0] * 10, np.full(len(chunks), -9.0)], axis=1)

    audio = spark.createDataFrame([("a", [0.1] * 8 + [0.0] * 4 + [0.01] * 2), ("b", []), ("c", None)], "audio_id string, samples array<float>")
    scores = inference.chunk_scores(audio, "samples", 4, 1.0, load, "small")
    got = {(r["audio_id"], r["chunk"], r["label"]): r for r in scores.collect()}
    assert {k[0] for k in got} == {"a", "b", "c"} and not any(k[2] == 2 for k in got)
    a = lambda c, k: got["a", c, k]["confidence"]
    assert abs(a(0, 0) - 1 / (1 + np.exp(-(0.9 * 4 - 2)))) < 1e-6 and abs(a(0, 0) - a(1, 0)) < 1e-9
    assert abs(a(2, 1) - 0.5) < 1e-9 and abs(a(3, 1) - 1 / (1 + np.exp(-5))) < 1e-6 and got["a", 3, 0]["end"] == 3.5
    best = {(r["audio_id"], r["label"]): r for r in inference.detections(scores).collect()}
    assert best["a", 0]["at"] == 0.0 and best["a", 1]["at"] == 0.0
    assert all(r["rank"] <= 1 for r in inference.timeline(scores, 1).collect())


def test_model_as_a_table_function(spark, monkeypatch):
    """The same rows as in Arrow batches, also with null and empty recordings, a few chunks at a time."""
    def load():
        import numpy as np

        return lambda chunks: np.stack([chunks.sum(axis=1), -chunks.sum(axis=1)], axis=1)

    monkeypatch.setattr(inference, "AT_ONCE", 2)
    audio = spark.createDataFrame([("a", [float(k % 5) / 10 for k in range(30)]), ("b", []), ("c", None)], "audio_id string, samples array<float>")
    audio.createOrReplaceTempView("audio_rows")
    inference.register_model(spark, "two_labels", 4, 1.0, load, "two", 0.1)
    got = spark.sql("select audio_id, t.* from audio_rows, lateral two_labels(samples) t")
    want = inference.chunk_scores(audio, "samples", 4, 1.0, load, "two", 0.1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("audio_id = 'a'").count() > 8
