"""Removal of repeated 200-byte strings by merged transforms of their anchored suffixes.

Shards of a Burrows-Wheeler transform are merged by refining their interleave
symbol by symbol, which yields common prefixes and repeated intervals without
sorting suffixes again.  Refining the suffixes of *all* byte positions would take
a shuffle of every position for each round, so the transform is sparse: of the
169 grams of 32 bytes in a 200-byte string the least by hash is its anchor, and
only suffixes that start at anchors, of which equal strings have equal ones, are
interleaved, with the bytes before them; see ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats

KIND = repeats.Kind(size=200, gram=32, words=False)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in repeats.pieces(batch.column(1)):
            gone, at, data, *_ = repeats.covers(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), KIND)
            kept = data[~gone]
            left = np.concatenate([[0], np.cumsum(~gone)])[at]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = at[:-1][np.diff(at) > 0]
            edge[heads] = gone[heads]
            starts = np.flatnonzero(edge)
            stops = gone.copy()
            stops[:-1] &= ~gone[1:]
            stops[at[1:][np.diff(at) > 0] - 1] = gone[at[1:][np.diff(at) > 0] - 1]
            ends = np.flatnonzero(stops) + 1
            runs = np.searchsorted(starts, at)
            spans = np.stack([starts, ends], axis=1) - np.repeat(at[:-1], np.diff(runs))[:, None]
            sizes = np.diff(at)
            texts = [kept[x:y].tobytes() for x, y in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["start", "end"])
            cols = [batch.column(0).slice(a, b - a), pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pairs), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "kept", "spans", "n_bytes"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sums = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(1)]
        n_bytes = batch.column(3).to_numpy()
        kept = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[: batch.num_rows + 1])
        cols = [batch.column(0), batch.column(3), pa.array(n_bytes - kept), batch.column(2).value_lengths().cast(pa.int64()), pa.array(sums, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_cuts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = repeats.sources(docs, id_col, text_col)
    return rows.join(repeats.cuts(rows, KIND, earlier=False), ["doc", "h"], "left").select("doc_id", "text", "cuts")


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kept (the bytes that stay), spans (start, end of what goes), n_bytes.

    A null text is empty; a null id stays null; repeated rows repeat each other's
    strings, so all of them go.  Bytes may be cut inside a code point.  Other
    columns are not looked at; an empty table gives an empty result.
    """
    return _with_cuts(docs, id_col, text_col).mapInArrow(_cut, "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``without_repeated_bytes`` as doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _with_cuts(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
