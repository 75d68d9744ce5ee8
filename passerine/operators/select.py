"""Best-per-key, top-k and key-set operators; every choice has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def best_by(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row of each key with the largest score, then the smallest ties: partial aggregations, no sort.

    Scores are numbers; a null one is the least, and a null tie the smallest.
    Ties may be of any type that can be compared.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), *[F.col(t) for t in ties])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def balanced_sample(df: DataFrame, key: str, order: Sequence[Column], most: int, least_members: int = 2) -> DataFrame:
    """min(most, smallest group) rows of each group that has enough members."""
    sizes = df.groupBy(key).count().where(F.col("count") >= least_members)
    n = sizes.agg(F.least(F.lit(most), F.min("count")).alias("n"))
    w = W.partitionBy(key).orderBy(*order)
    # the literal limit reaches the window, so a task keeps ``most`` rows of a group and sorts no more
    ranked = df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= most)
    least = n.join(sizes.select(key), F.lit(True))
    return ranked.join(least, key).where(F.col("rank_in_group") <= F.col("n")).drop("n")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces the rows of ``base`` with its keys."""
    return base.join(new, list(keys), "left_anti").unionByName(new)


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each key the values at floor(q * (n - 1)) of its sorted values, exactly, without gathering a key's rows.

    Equal values are counted first.  Counts of sixteenths of an octave, of which a
    key has few, are added up to find the one that holds each rank; only inside it
    are single values counted up.  Null and NaN values don't count.
    """
    v = F.col(value).cast("double")
    octave = lambda x: F.floor(16 * F.log2(x)).cast("int") + 20000
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).count().withColumn("cell", F.when(F.col("v") > 0, octave(F.col("v"))).when(F.col("v") < 0, -octave(-F.col("v"))).otherwise(0))
    cells = counted.groupBy(*keys, "cell").agg(F.sum("count").alias("n"))
    up = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(float(q)) * (F.col("all") - 1)).alias("rank")) for name, q in quantiles.items()])
    cells = cells.withColumn("ask", F.filter(asked, lambda a: (a["rank"] >= F.col("before")) & (a["rank"] < F.col("before") + F.col("n")))).where(F.size("ask") > 0)
    inside = W.partitionBy(*keys, "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    held = counted.join(cells.select(*keys, "cell", "before", "ask"), [*keys, "cell"])
    held = held.withColumn("upto", F.col("before") + F.sum("count").over(inside))
    picked = held.select(*keys, "v", F.explode(F.filter("ask", lambda a: (a["rank"] < F.col("upto")) & (a["rank"] >= F.col("upto") - F.col("count")))).alias("a"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("a.name") == name, F.col("v"))).alias(name) for name in quantiles])


def limited(df: DataFrame, order: Sequence[Column], most: int, n: int) -> DataFrame:
    """The first min(most, n) rows in order."""
    return df.orderBy(*order).limit(min(most, n))
