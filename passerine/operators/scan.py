"""Running values along one long key, spread over all tasks: a segmented scan.

A window over a key puts all its rows into one task.  Here the rows are cut into
segments of time; a window runs inside each of them, a second one over one small row
a segment hands the carry from segment to segment, and a join brings it back.  A
segment has about its share of the rows, so a single key of any length uses all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Segments that a table's time is cut into.
SEGMENTS = 64


def segmented(df: DataFrame, time: str, name: str = "_seg", segments: int = SEGMENTS) -> DataFrame:
    """``df`` with the number of its segment: ranges of ``time`` with about equally many rows; nulls are in the first.

    Rows of one time are in one segment.
    """
    number = F.col(time).cast("double") if dict(df.dtypes)[time] not in ("timestamp", "timestamp_ntz") else F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    cuts = df.agg(F.percentile_approx(number, [k / segments for k in range(1, segments)], 100 * segments)).first()[0] or []
    bounds = sorted(set(cuts))
    return df.withColumn(name, F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= number)), F.lit(0)) if bounds else F.lit(0))


def back(df: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the carry of its segment; null keys are a key like others."""
    renamed = carries.withColumnsRenamed({k: f"{k}__" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"{k}__" for k in keys])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, seg: str = "_seg") -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of its key, in the order of the columns."""
    inside = W.partitionBy(*keys, seg).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(seg).rowsBetween(W.unboundedPreceding, -1)
    carries = df.groupBy(*keys, seg).agg(F.sum(value).alias("_s")).select(*keys, seg, F.sum("_s").over(before).alias("_carry"))
    out = back(df.withColumn(name, F.sum(value).over(inside)), carries, [*keys, seg])
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry")


def last_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, own: bool = False, seg: str = "_seg") -> DataFrame:
    """``df`` with the last ``value`` that is not null before each row of its key; with ``own`` up to and with it."""
    inside = W.partitionBy(*keys, seg).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    before = W.partitionBy(*keys).orderBy(seg).rowsBetween(W.unboundedPreceding, -1)
    last = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    carries = df.groupBy(*keys, seg).agg(last.alias("_l")).select(*keys, seg, F.last("_l", ignorenulls=True).over(before).alias("_carry"))
    out = back(df.withColumn(name, F.last(value, ignorenulls=True).over(inside)), carries, [*keys, seg])
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def next_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, seg: str = "_seg") -> DataFrame:
    """``df`` with the first ``value`` that is not null after each row of its key."""
    inside = W.partitionBy(*keys, seg).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    after = W.partitionBy(*keys).orderBy(seg).rowsBetween(1, W.unboundedFollowing)
    first = F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))
    carries = df.groupBy(*keys, seg).agg(first.alias("_f")).select(*keys, seg, F.first("_f", ignorenulls=True).over(after).alias("_carry"))
    out = back(df.withColumn(name, F.first(value, ignorenulls=True).over(inside)), carries, [*keys, seg])
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
