"""Best rows and islands of keys, kept up to date by a stream.

Event times are TIMESTAMPs.  The late-data rule is Spark's: a row is dropped once
the watermark, the largest event time less ``late``, has passed it (for windows:
has passed its window).  Without ``late`` nothing is dropped or forgotten, and any
order of the input gives what the batch operator gives; with it this holds for
rows that are less late.  Rows without an event time take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import changelog

#: What an island is, after its key; times are microseconds.
ISLAND = "first long, last long, n long, peak double, open boolean"
_STATE = "first array<long>, last array<long>, n array<long>, peak array<double>"


def _timed(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    return timed.withWatermark(time, late) if late else timed


def best_per_window(rows: DataFrame, keys: Sequence[str], time: str, width: str, score: str, ties: Sequence[str], late: str | None = None) -> DataFrame:
    """start and the row of each key and window with the largest score, then the smallest ties; in update mode each time it gets better.

    ``select.best_by`` as a streaming aggregation: state is one row a key and window,
    combined before the shuffle.
    """
    timed = _timed(rows, time, late)
    rest = [c for c in timed.columns if c not in keys]
    order = F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), *[F.col(t) for t in ties])
    best = timed.groupBy(*keys, F.window(time, width).alias("_w")).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, F.col("_w.start").alias("start"), *[F.col("_b")[c].alias(c) for c in rest])


def merged(first: np.ndarray, last: np.ndarray, n: np.ndarray, peak: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Intervals in order, those with at most ``gap`` between them made one."""
    by = np.argsort(first, kind="stable")
    first, last, n, peak = first[by], last[by], n[by], peak[by]
    reach = np.maximum.accumulate(last)
    at = np.flatnonzero(np.r_[True, first[1:] - reach[:-1] > gap])
    return first[at], np.maximum.reduceat(last, at), np.add.reduceat(n, at), np.fmax.reduceat(peak, at)


def islands(rows: DataFrame, key: str, time: str, value: str, active: Column, gap: float, late: str | None = None) -> DataFrame:
    """key and its islands: runs of active rows with at most ``gap`` seconds from one to the next.

    Changes for ``changelog``, in update mode: a key that a batch touches gives all its
    open islands, and those that the batch closed.  first and last are microseconds,
    n counts rows and peak is the largest value (null if all are).  An island is closed
    once the watermark is ``gap`` past its end, by a timer if no row comes; closed ones
    leave the state, which holds intervals only, so it is as small as a key's open
    islands are few.  A session window can't do this: it tells nothing before it closes.
    """
    step = round(gap * 1_000_000)
    on = _timed(rows, time, late).where(active)
    on = on.select(key, time, F.unix_micros(time).alias("_at"), F.col(value).cast("double").alias("_v"))
    kind = on.schema[key].dataType.simpleString()

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(np.array(x, t) for x, t in zip(state.get, (np.int64, np.int64, np.int64, float))) if state.exists else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, float))
        for rows_ in batches:
            at = rows_["_at"].to_numpy(np.int64)
            new = at, at, np.ones(len(at), np.int64), rows_["_v"].to_numpy(float)
            if len(at):
                now = merged(*[np.concatenate(p) for p in zip(now, new)], step)
        mark = state.getCurrentWatermarkMs() * 1000 if late else -(2**62)
        done = now[1] + step <= mark
        left = [p[~done] for p in now]
        if len(left[0]):
            state.update(tuple(p.tolist() for p in left))
            if late:
                state.setTimeoutTimestamp(max(int((left[1].min() + step) // 1000 + 1), mark // 1000 + 1))
        elif state.exists:
            state.remove()
        out = pd.DataFrame({key: [name[0]] * len(done), "first": now[0], "last": now[1], "n": now[2], "peak": now[3], "open": ~done})
        yield out.astype({"peak": object}).where(out["peak"].notna().to_numpy()[:, None] | (out.columns != "peak"), None)

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return on.groupBy(key).applyInPandasWithState(advance, f"`{key}` {kind}, {ISLAND}", _STATE, "update", timeout)


def standing(changes: DataFrame, key: str) -> DataFrame:
    """The rows of ``islands`` that still hold: closed ones, and the open ones of a key's last batch; with ``batch``."""
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_batch"))
    both = changes.join(last, F.col(key).eqNullSafe(F.col("_key")))
    return both.where(~F.col("open") | (F.col("batch") == F.col("_batch"))).drop("_key", "_batch")


def best_kept(spark, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The table that ``best_per_window`` has written so far."""
    return changelog.latest(changelog.changes(spark, path, schema), [*keys, "start"]).drop("batch")


def islands_kept(spark, path: str, key: str, kind: str) -> DataFrame:
    """The table that ``islands`` has written so far."""
    return standing(changelog.changes(spark, path, f"`{key}` {kind}, {ISLAND}"), key).drop("batch")
