"""A classifier over chunks of recordings: one recording in, many scored rows out.

The model is the caller's: a function that loads it, once in each Python worker,
and gives a function from a matrix of chunks to a matrix of logits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Chunks of a recording that a model gets at once.
AT_ONCE = 512
_loaded: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def _session(name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """The model, loaded once in each Python worker."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _chunked(x: np.ndarray, size: int) -> np.ndarray:
    """Whole chunks, the last filled with zeros, one at least; each with a peak of 0.9, with a gain of 50 at most."""
    chunks = np.zeros((max(1, -(-len(x) // size)), size), np.float32)
    chunks.ravel()[: len(x)] = x
    peak = np.abs(chunks).max(axis=1, keepdims=True)
    return chunks * np.where(peak > 1e-6, np.minimum(50, 0.9 / np.maximum(peak, 1e-9)), 1.0).astype(np.float32)


def _scored(x: np.ndarray, rate: int, seconds: float, model: Callable, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """chunk, start, end, label, confidence of what is sure enough, ``AT_ONCE`` chunks at a time."""
    size = int(rate * seconds)
    for first in range(0, max(1, -(-len(x) // size)), AT_ONCE):
        part = x[first * size : (first + AT_ONCE) * size]
        sure = 1 / (1 + np.exp(-np.asarray(model(_chunked(part, size)), np.float64)))
        c, k = np.nonzero(sure >= least)
        chunk = c.astype(np.int64) + first
        yield chunk, chunk * float(seconds), np.minimum((chunk + 1) * float(seconds), len(x) / rate), k.astype(np.int64), sure[c, k]


def chunk_scores(audio: DataFrame, samples: str, rate: int, seconds: float, load: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str, least: float = 0.03) -> DataFrame:
    """audio_id, chunk, start, end, label, confidence of every label at or above ``least`` in every chunk.

    Chunks don't overlap; the last is filled with zeros, its end is the recording's,
    and there is one at least.  Each is brought to a peak of 0.9, with a gain of 50
    at most.  ``label`` is the place of a logit; ``name`` tells models apart.  A long
    recording goes through the model ``AT_ONCE`` chunks at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _session(name, load)
        for batch in batches:
            for audio_id, x in zip(batch.column(0), batch.column(1), strict=True):
                x = np.asarray(x.values, np.float32) if x.is_valid else np.zeros(0, np.float32)
                for found in _scored(x, rate, seconds, model, least):
                    cols = [pa.array([audio_id.as_py()] * len(found[0]), pa.string()), *map(pa.array, found)]
                    yield pa.RecordBatch.from_arrays(cols, names=["audio_id", "chunk", "start", "end", "label", "confidence"])

    rows = audio.select(F.col("audio_id").cast("string"), samples)
    return rows.mapInArrow(run, "audio_id string, chunk long, start double, end double, label long, confidence double")


def register_model(spark: SparkSession, function: str, rate: int, seconds: float, load: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str, least: float = 0.03) -> None:
    """Make a model a table function of SQL: ``from audio, lateral function(samples)`` gives the rows of ``chunk_scores``.

    One session serves all calls in a worker; rows leave as they are made.  Null
    samples are an empty recording, which is one chunk of silence.
    """
    class Scores:
        def eval(self, samples):
            x = np.asarray([] if samples is None else samples, np.float32)
            for found in _scored(x, rate, seconds, _session(name, load), least):
                yield from zip(*(column.tolist() for column in found), strict=True)

    spark.udtf.register(function, F.udtf(Scores, returnType="chunk long, start double, end double, label long, confidence double"))


def detections(scores: DataFrame, most: int = 12) -> DataFrame:
    """audio_id, label, confidence, at: the best score of each label and the first chunk that has it, the ``most`` surest."""
    best = scores.groupBy("audio_id", "label").agg(F.max("confidence").alias("confidence"), F.min_by("start", F.struct((-F.col("confidence")).alias("c"), "chunk")).alias("at"))
    w = W.partitionBy("audio_id").orderBy(F.desc("confidence"), "label")
    return best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def timeline(scores: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` surest labels of each chunk, with their rank."""
    w = W.partitionBy("audio_id", "chunk").orderBy(F.desc("confidence"), "label")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
