"""Substring deduplication over the word graph whose edges are 13-word windows.

Edges that follow each other around one anchor are compacted into one path, a
block, before anything is shuffled.  Joins on the blocks' digests find the
repeated paths and the first document of each; paths that meet others around
their anchor, where the graph branches, are compared word by word; see
``repeats``.  The joins back to the source coordinates glue neighbouring paths
into the long spans of each document, from which the repeated words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

KIND = repeats.Kind(size=13, gram=4, words=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in repeats.pieces(batch.column(1)):
            gone, at, data, starts, ends = repeats.covers(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), KIND)
            removed = np.concatenate([[0], np.cumsum(gone)])
            texts = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = data[starts[x] : ends[y - 1]].tobytes().split() if y > x else []
                if removed[y] > removed[x]:
                    words = [w for w, g in zip(words, gone[x:y].tolist(), strict=True) if not g]
                texts.append(b" ".join(words))
            n_removed = removed[at[1:]] - removed[at[:-1]]
            cols = [batch.column(0).slice(a, b - a), pa.array(texts, pa.binary()), pa.array(np.diff(at)), pa.array(n_removed)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "kept", "n_words", "n_removed"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *batch.columns[2:]], names=batch.schema.names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sums = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], sums], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_cuts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = repeats.sources(docs, id_col, text_col)
    return rows.join(repeats.cuts(rows, KIND, earlier=True), ["doc", "h"], "left").select("doc_id", "text", "cuts")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kept (the words that stay, one space between), n_words, n_removed.

    A null text has no words; null ids come after all others; rows of one id are
    one document to each other, so neither loses words to the other.  Other
    columns are not looked at; an empty table gives an empty result.
    """
    return _with_cuts(docs, id_col, text_col).mapInArrow(_texts, "doc_id long, kept string, n_words long, n_removed long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``without_repeats`` as doc_id, n_words, n_removed, kept_sha256."""
    return _with_cuts(docs, id_col, text_col).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
