"""WAV files by byte ranges: whole, in pieces, or the windows asked for, at any rate.

Files are listed by Spark; a task opens a file where it lies and reads the bytes of
its own windows, so contents are never shuffled and a file may be larger than any
task's memory.  Other rates go through a polyphase windowed-sinc filter, which
takes away what lies above the new Nyquist frequency.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Crossings of the filter on each side, its pass band as a share of the new Nyquist frequency, and the shape of its window.
CROSSINGS, PASS, SHAPE = 32, 0.94, 9.0
#: Output samples that are filtered at once.
STEP = 1 << 15


@cache
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """Weights of the inputs around each of ``up`` phases, and how many there are on each side."""
    cut = 1.0 if up >= down else up / down * PASS
    half = int(np.ceil(CROSSINGS / cut))
    at = np.arange(-half, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    weights = np.sinc(at * cut) * np.i0(SHAPE * np.sqrt(np.maximum(1 - (at / (half + 1)) ** 2, 0)))
    return weights / weights.sum(axis=1, keepdims=True), half


def context(own: int, rate: int) -> int:
    """Input samples that the filter looks at on each side of a place."""
    if own == rate:
        return 0
    common = gcd(own, rate)
    return _phases(rate // common, own // common)[1]


def resample(x: np.ndarray, own: int, rate: int, n: int, lead: int = 0) -> np.ndarray:
    """n samples at ``rate`` from ``x`` at ``own``, the first one at ``x[lead]``; beyond ``x`` there are zeros."""
    if own == rate:
        out = np.zeros(n)
        part = x[lead : lead + n]
        out[: len(part)] = part
        return out
    common = gcd(own, rate)
    up, down = rate // common, own // common
    weights, half = _phases(up, down)
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + max(0, lead + (n * down) // up + 1 - len(x)))])
    out = np.empty(n)
    for first in range(0, n, STEP):
        place = np.arange(first, min(n, first + STEP), dtype=np.int64) * down
        near = (place // up + lead)[:, None] + np.arange(2 * half + 1)[None, :]
        out[first : first + len(place)] = np.einsum("ij,ij->i", padded[near], weights[place % up])
    return out


class Wav:
    """A WAV file that is read by byte ranges: PCM of 8 to 32 bits or floats, also beyond 4 GB (RF64)."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        # Spark writes local paths with one slash
        uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        where, name = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(name)
        length = self.file.size()
        form, _, kind = struct.unpack("<4sI4s", self.file.read_at(12, 0))
        if form not in (b"RIFF", b"RF64") or kind != b"WAVE":
            raise ValueError(f"{path} is no WAV file")
        at, large, found = 12, None, None
        while at + 8 <= length:
            name, size = struct.unpack("<4sI", self.file.read_at(8, at))
            if name == b"ds64":
                large = struct.unpack("<QQ", self.file.read_at(16, at + 8))[1]
            elif name == b"fmt ":
                told = self.file.read_at(min(size, 26), at + 8)
                tag, self.channels, self.rate, _, self.block, bits = struct.unpack("<HHIIHH", told[:16])
                self.floats = (struct.unpack("<H", told[24:26])[0] if tag == 0xFFFE and len(told) >= 26 else tag) == 3
                self.width = bits // 8
            elif name == b"data":
                found = at + 8
                size = large if large is not None and size == 0xFFFFFFFF else size
                self.frames = min(size, length - found) // self.block
                break
            at += 8 + size + size % 2
        if found is None:
            raise ValueError(f"{path} has no samples")
        self.start = found

    def read(self, first: int, n: int) -> np.ndarray:
        """Mono samples in [-1, 1] of the frames from ``first`` on, ``n`` at most: channels are averaged."""
        first = min(max(first, 0), self.frames)
        raw = self.file.read_at(min(n, self.frames - first) * self.block, self.start + first * self.block)
        if self.floats:
            x = np.frombuffer(raw, f"<f{self.width}").astype(np.float64)
        elif self.width == 3:
            whole = np.zeros((len(raw) // 3, 4), np.uint8)
            whole[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            x = whole.view("<i4").ravel() / 2**31
        elif self.width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
        else:
            x = np.frombuffer(raw, f"<i{self.width}") / float(2 ** (8 * self.width - 1))
        return x.reshape(-1, self.channels).mean(axis=1)

    def window(self, rate: int, start: float, samples: int | None) -> np.ndarray:
        """Samples at ``rate`` from ``start`` seconds on, zeros beyond the end; without a number, all of them."""
        first, side = int(start * self.rate), context(self.rate, rate)
        n = int(max(0, self.frames - first) * rate / self.rate + 1e-9) if samples is None else samples
        lead = min(first, side)
        x = self.read(first - lead, lead + -(-n * self.rate // rate) + side + 1)
        return resample(x, self.rate, rate, n, lead).astype(np.float32)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """audio_id (the name without folders and extension) and path of the WAV files below ``path``; of equal names the last path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return found.groupBy(name.alias("audio_id")).agg(F.max("path").alias("path"))


def _read(rows: DataFrame, rate: int, least: float) -> DataFrame:
    """Rows with path, start and end (null: to the end of the file): samples instead of the path."""
    at = {c: rows.columns.index(c) for c in ("path", "start", "end")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wav = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, start, end = (row.column(at[c])[0].as_py() for c in ("path", "start", "end"))
                if path != held:
                    held, wav = path, Wav(path)
                n = None if end is None else int(np.ceil(round(max(least, end - start) * rate, 6)))
                x = wav.window(rate, start or 0.0, n)
                kept = [k for k in range(row.num_columns) if k != at["path"]]
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in kept), pa.array([x], pa.list_(pa.float32()))], names=[*(row.schema.names[k] for k in kept), "samples"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop("path").dtypes)
    return rows.mapInArrow(run, f"{kinds}, samples array<float>")


def read_audio(spark: SparkSession, path: str, rate: int = 22050, windows: DataFrame | None = None, least: float = 1.0) -> DataFrame:
    """audio_id and samples of WAV files: whole, or for each row of ``windows`` (audio_id, start, end) its part.

    A window has the samples of its length, of ``least`` seconds at least, with
    zeros beyond the end of the file, and keeps its columns; only its bytes are read,
    and those that the filter looks at.  A window without a file is left out.  A file
    that is read whole must fit in a row; ``read_pieces`` reads longer ones.
    """
    found = wav_files(spark, path)
    if windows is None:
        return _read(found.select("audio_id", "path", F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("end")), rate, least).drop("start", "end")
    times = windows.withColumns({c: F.col(c).cast("double") for c in ("start", "end")})
    return _read(times.join(found, "audio_id").select(*[c for c in ("audio_id", "start", "end")], *[c for c in windows.columns if c not in ("audio_id", "start", "end")], "path"), rate, least)


def read_pieces(spark: SparkSession, path: str, rate: int = 22050, seconds: int = 60) -> DataFrame:
    """audio_id, start, end and samples of all WAV files in pieces of whole seconds, each read by a task of its own.

    Pieces put together are the whole file: the filter looks across their borders.
    """
    found = wav_files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = [(w := Wav(p)).frames / w.rate for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(long, pa.float64())], names=["audio_id", "path", "long"])

    sized = found.mapInArrow(run, "audio_id string, path string, long double").where("long > 0")
    each = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("long") / seconds) - 1, F.lit(0)).cast("int")))).withColumn("start", F.col("piece") * F.lit(float(seconds)))
    spans = each.select("audio_id", "start", F.least(F.col("start") + seconds, F.col("long")).alias("end"), "path").repartition("path", "start")
    return _read(spans, rate, 0.0)
