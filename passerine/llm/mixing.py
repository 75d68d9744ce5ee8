"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Documents are dealt to ``BUCKETS``
ranges of that key within each source, the sums of the ranges are added up to
each range's offset, and a running sum inside a range gives a document's
position in its source's random order: a distributed prefix sum in which no
task sees more than one range of one source.  A source's order is cut at its
exact budget; a budget beyond the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Ranges of the random key in each source: 16 ** 3, the first hex digits of the key.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: water-filling of ``share`` of all sizes.

    ``sizes`` has a row per source.  With sources in the order of most * size /
    weight, the first ones reach their limits; the rest share what is left by
    weight.  The level rises until nobody is above its limit, and falls after that,
    so it is the largest of the prefixes' levels.
    """
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", F.col("source_size"), w.alias("w")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    before = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "used": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("left"))
    fits = F.col("level") * F.col("w") <= F.col("limit")
    s = s.withColumn("final", F.max(F.when(fits, F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("final") * F.col("w"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weights=WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    A null text has size 0, a null source is a source (the last), a null id is
    ordered as the text 'null'.  Repeated rows are separate documents; they tie,
    and whichever comes first takes the same as the other would.  The words of
    the document at the cut count as far as the budget goes.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_or_empty(text_col)).alias("size")
    ).select("*", key.alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = ranges.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = targets(sizes, weights)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    offsets = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(
        offsets["source"].alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target"
    )
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")
