"""Spectra from frames of samples, and band indices of spectra.

Transforms run on Arrow batches, a matrix product for a whole batch; indices
are array expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MEL_FILTERS, COEFFICIENTS, LOWEST_HZ = 26, 13, 50.0


def mel_filters(size: int, rate: float, filters: int = MEL_FILTERS, lowest: float = LOWEST_HZ) -> np.ndarray:
    """Triangles evenly spaced in mel from ``lowest`` to half the rate: filters x bins of a transform of ``size``."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = np.linspace(mel(lowest), mel(rate / 2), filters + 2)
    edges = np.floor((size + 1) * 700 * (10 ** (points / 2595) - 1) / rate)
    bins = np.arange(size // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up = np.where(mid > low, (bins - low) / np.maximum(mid - low, 1), 0)
    down = np.where(high > mid, (high - bins) / np.maximum(high - mid, 1), 0)
    return np.where((bins >= low) & (bins < mid), up, np.where((bins >= mid) & (bins < high), down, 0))


def cepstrum(power: np.ndarray, rate: float, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """Unnormalised type-two cosine transform of the log mel energies of power spectra (rows)."""
    energy = np.log(power @ mel_filters(2 * (power.shape[1] - 1), rate).T + 1e-12)
    n = energy.shape[1]
    return energy @ np.cos(np.pi * np.outer(np.arange(n) + 0.5, np.arange(coefficients)) / n)


def _per_row(df: DataFrame, frame_col: str, out_col: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            frames = batch.column(names.index(frame_col))
            whole = np.stack(frames.to_numpy(zero_copy_only=False)).astype(np.float64) if batch.num_rows else np.zeros((0, 2))
            out = pa.array(list(f(whole)) if len(whole) else [], pa.list_(pa.float64()))
            kept = [n for n in names if n != frame_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(n)) for n in kept], out], names=[*kept, out_col])

    kept = df.drop(frame_col, out_col)
    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return df.select(*kept.columns, frame_col).where(F.col(frame_col).isNotNull()).mapInArrow(run, f"{fields}, `{out_col}` array<double>")


def magnitudes(df: DataFrame, frame_col: str, out_col: str = "magnitude", window: bool = True) -> DataFrame:
    """Magnitude spectrum (half the size and one bins) of each frame, Hamming-windowed; frames have one length, null ones go."""
    return _per_row(df, frame_col, out_col, lambda x: np.abs(np.fft.rfft(x * (np.hamming(x.shape[1]) if window else 1.0), axis=1)))


def mfcc(df: DataFrame, frame_col: str, rate: float, out_col: str = "mfcc", coefficients: int = COEFFICIENTS) -> DataFrame:
    """Mel-frequency cepstral coefficients of each frame."""
    return _per_row(df, frame_col, out_col, lambda x: cepstrum(np.abs(np.fft.rfft(x * np.hamming(x.shape[1]), axis=1)) ** 2, rate, coefficients))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def rolloff_bin(magnitude: Column, share: float = 0.85) -> Column:
    """First bin (from 0) up to which ``share`` of the sum lies; null for an empty spectrum."""
    limit = _sum(magnitude) * share
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct((s["c"] + x).alias("c"), (s["n"] + F.when(s["c"] + x < limit, 1).otherwise(0)).alias("n"))
    return F.when(F.size(magnitude) > 0, F.aggregate(magnitude, start, step)["n"])


def soundscape_index(magnitude: Column, hz: float, low: float = 1000.0, high: float = 2000.0) -> Column:
    """(biophony - anthropophony) / their sum; anthropophony has bins from low to high, biophony those above; 0 without either."""
    part = lambda test: _sum(F.transform(magnitude, lambda x, i: F.when(test(i * hz), x).otherwise(0.0)))
    anthro, bio = part(lambda f: (f >= low) & (f < high)), part(lambda f: f >= high)
    return F.when(anthro + bio > 0, (bio - anthro) / (bio + anthro)).otherwise(F.lit(0.0))


def bioacoustic_index(magnitude: Column, hz: float, low: float = 2000.0, high: float = 8000.0) -> Column:
    """Area of the decibel curve over its least value between two frequencies, in dB kHz."""
    db = F.filter(F.transform(magnitude, lambda x, i: F.when((i * hz >= low) & (i * hz <= high), 10 * F.log10(x + 1e-12))), lambda x: x.isNotNull())
    return F.coalesce(_sum(F.transform(db, lambda x: x - F.array_min(db))) * (hz / 1000), F.lit(0.0))


def pitch_class(frequency: Column, a4: float = 440.0) -> Column:
    """Semitone from A, 0 to 11, of a frequency above 0."""
    return F.pmod(F.round(12 * F.log2(frequency / a4)).cast("int"), F.lit(12))
