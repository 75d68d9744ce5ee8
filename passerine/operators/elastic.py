"""Nearest contours by banded dynamic time warping, exact, with bounds that spare most alignments.

Contours of one length are rows of a ``metric_index``.  Warping a query within its band
can't take it out of its envelope, so a contour is at least as far as it is from the
envelope (a box), which is at least its distance from the middle of the box less half
its diagonal; and it is at most as far as without any warping.  The first bounds leave
out rings of the index, the distances from both envelopes leave out rows of a
visited block, and only what is left is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..sources.storage import written
from . import metric_index
from .metric_index import SLACK, stack

#: Alignments that are made at once.
TOGETHER = 1 << 16


def resampled(values: Column, length: int) -> Column:
    """``length`` values at even places of a list, on the lines between its own; null for an empty or null list."""
    at = lambda k: k / max(1, length - 1) * (F.size(values) - 1)
    low = lambda k: F.floor(at(k)).cast("int")
    line = lambda k: F.get(values, low(k)) + (F.coalesce(F.get(values, low(k) + 1), F.get(values, low(k))) - F.get(values, low(k))) * (at(k) - low(k))
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), line))


def warped(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Squared cost of the best alignment of each row of two matrices, places at most ``band`` apart."""
    n = x.shape[1]
    last = np.full((n + 1, len(x)), np.inf)
    last[0] = 0
    for i in range(n):
        now = np.full((n + 1, len(x)), np.inf)
        for j in range(max(0, i - band), min(n, i + band + 1)):
            now[j + 1] = (x[:, i] - y[:, j]) ** 2 + np.minimum(np.minimum(last[j], last[j + 1]), now[j])
        last = now
    return last[n]


def envelope(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value that each place can be aligned with; both ends are always aligned with each other."""
    n = x.shape[1]
    around = [x[:, i : i + 1] if i in (0, n - 1) else x[:, max(0, i - band) : i + band + 1] for i in range(n)]
    return np.stack([a.min(axis=1) for a in around], axis=1), np.stack([a.max(axis=1) for a in around], axis=1)


def outside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of all rows of a matrix (across) from all boxes (down)."""
    out = np.zeros((len(low), len(x)))
    for k in range(x.shape[1]):
        v = x[None, :, k]
        out += np.maximum(np.maximum(low[:, k, None] - v, v - high[:, k, None]), 0) ** 2
    return out


def _least(q: np.ndarray, limit: np.ndarray, base: np.ndarray, other: np.ndarray, band: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and squared cost of all pairs that can be among a query's k least in this block, and alignments made for each query."""
    # aligning is symmetric, so each is bounded by the other's envelope
    bound = np.maximum(outside(base, *envelope(q, band)), outside(q, *envelope(base, band)).T)
    bound = np.where(other & (bound <= limit[:, None] + SLACK), bound, np.inf)
    done, cost = np.zeros(bound.shape, bool), np.full(bound.shape, np.inf)
    take = min(k, bound.shape[1])
    first = np.argpartition(bound, take - 1, axis=1)[:, :take]
    ask = np.zeros(bound.shape, bool)
    np.put_along_axis(ask, first, True, axis=1)
    for _ in range(2):
        rows, cols = np.nonzero(ask & np.isfinite(bound) & ~done)
        for at in range(0, len(rows), TOGETHER):
            r, c = rows[at : at + TOGETHER], cols[at : at + TOGETHER]
            cost[r, c] = np.round(warped(q[r], base[c], band), 6)
        done[rows, cols] = True
        # what the first ones cost tells which of the rest can still be as near
        ask = bound <= np.partition(cost, take - 1, axis=1)[:, take - 1, None] + SLACK
    rows, cols = np.nonzero(done)
    keep = cost[rows, cols] <= np.partition(cost, take - 1, axis=1)[rows, take - 1]
    return rows[keep], cols[keep], cost[rows[keep], cols[keep]], done.sum(axis=1)


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, length: int, band: int, k: int = 1, seen: Observation | None = None) -> DataFrame:
    """q_id, id, d2, nn_rank, compared: the k nearest contours by warping, a row of its own id excluded, ties by id.

    Exact to 6 digits of the squared cost.  compared is how many alignments the query
    took beyond the k that bound it first, and ``seen`` gets the blocks that queries visited.  A query with fewer than k
    others has all of them.  Contours that are null, of another length, or hold a null
    or NaN take no part; ids are long and unique, rows without one are left out.
    """
    whole = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        (F.size("v") == length) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    )
    index = metric_index.build(whole(base), "id", "v")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th least cost to the contours nearest without warping in a query's own block: its own can be no more."""
        for batch in batches:
            for i in range(batch.num_rows):
                asked, own = (batch.column(c).slice(i, 1) for c in ("asked", "base"))
                q = asked.flatten()
                x, far = stack(q.field("v")), np.full(len(q), np.inf)
                if own[0].is_valid and len(own.flatten()) > k:
                    b = own.flatten()
                    d = metric_index.squared(x, stack(b.field("v")))
                    d[q.field("q").to_numpy()[:, None] == b.field("id").to_numpy()[None, :]] = np.inf
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    far = warped(np.repeat(x, k, axis=0), stack(b.field("v"))[near.ravel()], band).reshape(len(x), k).max(axis=1)
                yield pa.RecordBatch.from_arrays([q.field("q"), q.field("v"), pa.array(np.minimum(far, index.reach(x, k + 1) ** 2))], names=["q", "v", "far"])

    def choose(q: pa.StructArray, own: pa.StructArray | None) -> tuple[np.ndarray, pa.Array]:
        low, high = envelope(stack(q.field("v")), band)
        least = index.bounds((low + high) / 2)[0] - np.sqrt((((high - low) / 2) ** 2).sum(axis=1))[:, None]
        return least <= np.sqrt(q.field("far").to_numpy() + SLACK)[:, None] * (1 + 1e-9), pa.nulls(0, pa.int32())

    def step(q: pa.StructArray, b: pa.StructArray) -> pa.RecordBatch:
        qi, bi = q.field("q").to_numpy(), b.field("id").to_numpy()
        rows, cols, cost, made = _least(stack(q.field("v")), q.field("far").to_numpy(), stack(b.field("v")), qi[:, None] != bi[None, :], band, k)
        found = [np.concatenate([a, b]) for a, b in ((qi[rows], qi), (cost, np.full(len(qi), np.nan)), (np.zeros(len(rows), np.int64), made))]
        ids = pa.concat_arrays([pa.array(bi[cols], pa.int64()), pa.nulls(len(qi), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), ids, pa.array(found[1]), pa.array(found[2], pa.int64())], names=["q_id", "id", "d2", "made"])

    asked = whole(queries).select(F.col("id").alias("q"), "v")
    if not index.count:
        asked = asked.limit(0)
    if index.single:
        requests, _ = metric_index.packed(index, asked.withColumn("far", F.lit(float("inf"))), "q", "v", "far")
    else:
        first, _ = metric_index.packed(index, asked, "q", "v")
        bounded = written(first.join(index.blocks, ["cell", "ring", "part"], "left").select("asked", "base").mapInArrow(start, "q long, v array<double>, far double"))
        packed, kind = metric_index.packed(index, bounded, "q", "v", "far")
        requests = metric_index.requests(index, packed, kind, choose, "int")
    found = metric_index.visited(index, requests, step, "q_id long, id long, d2 double, made long", seen)
    # a block sends a query's best and their ties only
    ranked = found.withColumn("compared", F.sum("made").over(W.partitionBy("q_id"))).where("id is not null")
    ranked = ranked.withColumn("nn_rank", F.row_number().over(W.partitionBy("q_id").orderBy("d2", "id"))).where(F.col("nn_rank") <= k)
    return ranked.select("q_id", "id", "d2", "nn_rank", "compared")
