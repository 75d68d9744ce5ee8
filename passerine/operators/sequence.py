"""Ordered operators inside a group: deltas, islands, as-of and interval joins, hopping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import scan


def islands(df: DataFrame, key: str, order: str, start: str, active: Column, max_gap: int, least: int) -> DataFrame:
    """Runs of active rows; inactive runs of at most max_gap rows are filled, a leading one too, a trailing one never.

    A segmented scan: rows of one key, however many, are spread over all tasks.
    """
    rows = scan.segmented(df.select(key, start, order, active.alias("_on")), start)
    w = W.partitionBy(key, "_seg").orderBy(start, order)
    rows = rows.withColumn("_r", F.row_number().over(w))
    seen = rows.withColumn("_was", F.last(F.when(F.col("_on"), F.col("_r")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    inner = F.when(F.col("_on") & (F.col("_r") - F.col("_was") - 1 > max_gap), 1).otherwise(0)
    local = seen.withColumn("_new", F.sum(inner).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # one row a segment: what it has, then what comes before it, and whether its first active row begins a run
    on = F.when(F.col("_on"), F.col("_r"))
    parts = local.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("a"), F.max(on).alias("b"), F.max("_new").alias("m"))
    v = W.partitionBy(key).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_rows", F.coalesce(F.sum("n").over(v), F.lit(0)))
    parts = parts.withColumn("_last", F.last(F.col("_rows") + F.col("b"), ignorenulls=True).over(v))
    gap = F.col("_rows") + F.col("a") - F.coalesce(F.col("_last"), F.lit(0)) - 1
    parts = parts.withColumns({"_begins": F.when(F.col("a").isNotNull() & (F.col("_last").isNull() | (gap > max_gap)), 1).otherwise(0), "_first": F.col("_last").isNull() & (gap <= max_gap)})
    parts = parts.withColumn("_runs", F.coalesce(F.sum(F.col("_begins") + F.col("m")).over(v), F.lit(0)) + F.col("_begins"))
    found = scan.back(local.where("_on"), parts.select(key, "_seg", "_rows", "_runs", "_first"), [key, "_seg"])
    at = F.col("_rows") + F.col("_r")
    whole = found.select(key, (F.col("_runs") + F.col("_new")).cast("long").alias("island"), at.alias("_at"), F.when(F.col("_was").isNull() & F.col("_first"), F.lit(1)).otherwise(at).alias("_from"))
    out = whole.groupBy(key, "island").agg(F.min("_from").cast("int").alias("first_row"), F.max("_at").cast("int").alias("last_row"))
    return out.where(F.col("last_row") - F.col("first_row") + 1 >= least)


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """Last value of ``right`` at or before each row of ``left``: a union and one segmented scan, no range join.

    Of right rows at one time the one with the largest ``tie`` counts; a null value is passed over.
    """
    kinds = dict(right.dtypes)
    both = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(kinds[value]), "_tie": F.lit(None).cast(kinds[tie])}).unionByName(
        right.select(key, time, value, F.col(tie).alias("_tie")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    found = scan.last_value(scan.segmented(both, time), [key], [time, "_side", "_tie"], F.col(value), "_value", own=True)
    return found.withColumn(value, F.col("_value")).where("_side = 1").drop("_side", "_tie", "_seg", "_value")


def interpolated(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """Value of ``right`` at each row of ``left``, on the line from the last point at or before it to the next.

    After the last point its value holds; before the first there is none.  Times
    are numbers; of points at one time that with the largest ``tie`` is the last.
    """
    here = right.select(key, time, tie, F.struct(F.col(time).alias("t"), F.col(value).alias("x")).alias("_h"))
    points = scan.next_value(scan.segmented(here, time), [key], [time, tie], F.col("_h"), "_n")
    points = points.select(key, time, tie, F.struct(F.col("_h.t").alias("t"), F.col("_h.x").alias("x"), F.col("_n.t").alias("t2"), F.col("_n.x").alias("x2")).alias("_p"))
    at = asof(left, points, key, time, "_p", tie)
    part = (F.col(time) - F.col("_p.t")) / F.greatest(F.col("_p.t2") - F.col("_p.t"), F.lit(1e-3))
    moved = F.col("_p.x") + (F.col("_p.x2") - F.col("_p.x")) * F.least(F.lit(1.0), part)
    return at.withColumn(value, F.coalesce(moved, F.col("_p.x"))).drop("_p")


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int, first: str) -> DataFrame:
    """Every point with the span [start, end) that holds it, the one with the least ``first``; nulls where none does.

    Points and spans meet on the key and buckets of ``width``; rows of ``points``
    stay separate, whatever they hold.
    """
    p = points.withColumn("_k", F.floor(F.col(at) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn("_k", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    names = [c for c in spans.columns if c != key]
    s = s.select(F.col(key).alias("_key"), F.col("_k").alias("_b"), F.struct(F.col(first).alias("_f"), *[F.col(c).alias(f"_{c}") for c in names]).alias("_s"))
    meets = (F.col(key) == F.col("_key")) & (F.col("_k") == F.col("_b")) & (F.col(at) >= F.col("_s")[f"_{start}"]) & (F.col(at) < F.col("_s")[f"_{end}"])
    # equal points are counted, joined once, and dealt out again
    cols = points.columns
    grouped = p.groupBy(*cols, "_k").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    found = grouped.join(s, meets, "left").groupBy(*cols, "_n").agg(F.min_by("_s", F.col("_s._f")).alias("_s"))
    again = found.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return again.select(*cols, *[F.col("_s")[f"_{c}"].alias(c) for c in names])


def chunks(df: DataFrame, duration: str, seconds: float) -> DataFrame:
    """``df`` with chunk (from 0) and end: whole pieces of a duration, one at least; the last ends with it."""
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(duration), F.lit(0.0)) / seconds).cast("int"))
    out = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("chunk", F.col("chunk").cast("long"))
    return out.withColumn("end", F.least(F.coalesce(F.col(duration), F.lit(0.0)), (F.col("chunk") + 1) * seconds))


def stacked(df: DataFrame, keys: list[str], order: list[str], value: str, most: float) -> DataFrame:
    """``df`` with base and height of bars stacked in order up to ``most``; what begins beyond it goes."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("base", F.coalesce(F.round(F.sum(value).over(before), 9), F.lit(0.0))).where(F.col("base") < most)
    return out.withColumn("height", F.least(F.col(value), F.lit(most) - F.col("base")))
