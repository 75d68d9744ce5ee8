"""How well groups of points hold together, how two labellings agree, and where points lie densely.

Everything comes from sums of clusters or of cells, combined before they are
shuffled: no pair of points is ever made, and no group is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import scan

#: Parts that points are dealt to when they meet the sums of clusters, so no part grows with one cluster.
DEALT = 64


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cluster_sums(rows: DataFrame) -> DataFrame:
    """c, n, total (of each dimension) and squares of each cluster of rows with c and v."""
    dims = rows.select("c", F.posexplode("v").alias("k", "x")).groupBy("c", "k").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    parts = dims.groupBy("c").agg(F.max("n").alias("n"), F.sum("q").alias("squares"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("t"))
    return parts.select("c", "n", F.transform("t", lambda t: t["s"]).alias("total"), "squares")


def silhouettes(points: DataFrame, id_col: str, cluster: str, vec_col: str) -> DataFrame:
    """id, cluster, own (mean squared distance to the rest of its cluster), other (least mean to another cluster), silhouette.

    The mean squared distance of a row to a cluster follows from the cluster's sums, so
    the work is rows times clusters.  The only row of a cluster has 0, and so has one
    whose distances are all 0; with a single cluster there is no silhouette (null).
    Rows whose cluster is null, or whose vector is null, empty or holds a null, take no
    part; ids are unique, one null included, and vectors of one length.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = points.select(F.col(id_col).alias("id"), F.col(cluster).alias("c"), v.alias("v")).where("c is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))")
    sums = cluster_sums(rows).select(F.col("c").alias("_c"), F.col("n").alias("_n"), "total", "squares", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part"))
    met = rows.withColumn("_part", F.pmod(F.xxhash64("id", "v"), F.lit(DEALT)).cast("int")).join(sums, "_part")
    apart = F.col("_n") * _dot(F.col("v"), F.col("v")) - 2 * _dot(F.col("v"), F.col("total")) + F.col("squares")
    same = F.col("c") == F.col("_c")
    mean = F.greatest(apart, F.lit(0.0)) / F.when(same, F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(F.col("_n"))
    near = met.select("id", "c", same.alias("same"), mean.alias("d"), "_n").groupBy("id", "c").agg(
        F.max(F.when(F.col("same"), F.col("d"))).alias("own"), F.min(F.when(~F.col("same"), F.col("d"))).alias("other"), F.max(F.when(F.col("same"), F.col("_n"))).alias("n")
    )
    widest = F.greatest("own", "other")
    value = F.when(F.col("other").isNull(), F.lit(None)).when((F.col("n") == 1) | (widest == 0), 0.0).otherwise((F.col("other") - F.col("own")) / widest)
    return near.select(F.col("id").alias(id_col), F.col("c").alias(cluster), "own", "other", value.alias("silhouette"))


def adjusted_rand(df: DataFrame, one: str, other: str) -> DataFrame:
    """One row, rows and adjusted_rand: agreement of two labellings, 1 for the same groups, about 0 for chance.

    Rows with a null label take no part; fewer than two rows, or labellings that can't
    differ from chance, agree wholly.
    """
    pairs = lambda n: n * (n - 1) / 2
    cells = df.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(one).alias("a"), F.col(other).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(name))
    sums = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("both"))
    all_ = sums.join(side("a", "x"), F.lit(True)).join(side("b", "y"), F.lit(True))
    chance = F.coalesce(F.try_divide(F.col("x") * F.col("y"), pairs(F.col("rows"))), F.lit(0.0))
    most = (F.col("x") + F.col("y")) / 2
    return all_.select("rows", F.when(most == chance, 1.0).otherwise((F.col("both") - chance) / (most - chance)).alias("adjusted_rand"))


def density(points: DataFrame, keys: Sequence[str], position: Sequence[str], bandwidth: float, reach: float = 4.0, fine: float = 0.25) -> DataFrame:
    """Keys, n_<axis>, density, bound: the density cloud of each group at nodes one bandwidth apart.

    A node stands at ``n * bandwidth`` on each axis; nodes within ``reach`` bandwidths of
    a cell's mean are returned.  Points are first combined in cells of ``fine`` bandwidths,
    so a crowd in one place costs as much as a single point.  The true Gaussian density
    is at most ``bound`` from the returned one: a cell's mean stands for its points with an
    error of second order, known from their variance, and cells out of reach add no more
    than the kernel at that distance.  Rows with a null, NaN or infinite place take no part.
    """
    d, h = len(position), float(bandwidth)
    whole = [F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")) for p in position]
    rows = points.select(*keys, *[F.col(p).cast("double").alias(p) for p in position])
    for test in whole:
        rows = rows.where(test)
    cells = rows.groupBy(*keys, *[F.floor(F.col(p) / (fine * h)).alias(f"_c_{p}") for p in position]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(p).alias(f"_m_{p}") for p in position], sum((F.var_pop(p) for p in position), F.lit(0.0)).alias("_v")
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    far = F.lit(0.0)
    for p in position:
        low, high = F.ceil(F.col(f"_m_{p}") / h - reach), F.floor(F.col(f"_m_{p}") / h + reach)
        cells = cells.withColumn(f"n_{p}", F.explode(F.sequence(low, high)))
        far = far + (F.col(f"n_{p}") * h - F.col(f"_m_{p}")) * (F.col(f"n_{p}") * h - F.col(f"_m_{p}"))
        cells = cells.withColumn("_far", far).where(F.col("_far") <= (reach * h) ** 2)
    nodes = [f"n_{p}" for p in position]
    found = cells.groupBy(*keys, *nodes).agg(
        F.sum(F.col("_n") * F.exp(-F.col("_far") / (2 * h * h))).alias("_k"), F.sum(F.col("_n") * F.col("_v") / (2 * h * h)).alias("_e"), F.sum("_n").alias("_in")
    )
    both = scan.back(found, sizes, list(keys)) if keys else found.join(sizes, F.lit(True))
    norm = F.col("_all") * ((2 * math.pi) ** (d / 2) * h**d)
    outside = (F.col("_all") - F.col("_in")) * math.exp(-((max(0.0, reach - math.sqrt(d) * fine)) ** 2) / 2)
    return both.select(*keys, *nodes, (F.col("_k") / norm).alias("density"), ((F.col("_e") + outside) / norm).alias("bound"))
