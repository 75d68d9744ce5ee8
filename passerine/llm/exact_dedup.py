"""Exact deduplication by skew-safe combining.

Copies are combined in three steps, each of which compares whole contents:

1. every map task merges the equal texts among its own rows (Spark's partial
   aggregation, keyed by digest, salt and content);
2. one shuffle merges what has met in the same (digest, salt) slice.  Only hot
   digests, those of at least ``1 / HOT_SHARE`` of all rows, get more than one
   salt, so at most ``HOT_SHARE`` digests are broadcast whatever the input;
3. the winners of a hot digest's salts are merged by digest and content.  The
   other contents pass this step under two more digests instead of their text,
   which are the same if a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LAST_ID, SPACES, checkpoint, text_or_empty, with_row_number

#: A digest with more than this part of all rows is salted: fewer than so many digests can be.
HOT_SHARE = 1024
SALTS = 16


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _rank(text: Column, doc_id: Column) -> Column:
    """One number that orders by length in code points, then by smallest id (null last)."""
    length = F.length(text).cast("decimal(11,0)")
    return length * F.lit("1" + "0" * 20).cast("decimal(21,0)") - F.coalesce(doc_id, F.lit(LAST_ID)).cast("decimal(20,0)")


def _classes(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """digest, keep_id, best (rank), group_size: one row for each distinct content."""
    salted = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "digest", "left").withColumn(
        "salt", F.when(F.col("is_hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    )
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.max_by("doc_id", "rank").alias("doc_id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n")
    )
    passed = merged.select(
        "digest",
        F.when(F.col("salt").isNotNull(), F.col("content")).alias("content"),
        F.when(F.col("salt").isNull(), F.struct(F.xxhash64("content"), F.xxhash64("content", F.lit(1)))).alias("alone"),
        "doc_id",
        "rank",
        "n",
    )
    return passed.groupBy("digest", "content", "alone").agg(
        F.max_by("doc_id", "rank").alias("keep_id"), F.max("rank").alias("best"), F.sum("n").alias("group_size")
    ).select("digest", "keep_id", "best", "group_size")


def _assigned(source: DataFrame, row: Column, digest) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 of every row of ``source`` (doc_id, text, and what ``row`` needs)."""
    rows = source.select(
        row.alias("row"), "doc_id", normalised(F.col("text")).alias("content"), _rank(F.col("text"), F.col("doc_id")).alias("rank")
    ).withColumn("digest", digest(F.col("content")))
    digests = checkpoint(rows.select("row", "doc_id", "rank", "digest", F.sha2("content", 256).alias("text_sha256")))
    total = digests.count()
    counts = digests.groupBy("digest").count()
    hot = counts.where((F.col("count") > 1) & (F.col("count") * HOT_SHARE > total)).select("digest")
    classes = checkpoint(_classes(rows.drop("row"), hot))

    shared = classes.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        joined = digests.join(classes, "digest")
    else:  # a digest stands for several contents: those documents are joined by content
        own = classes.join(shared, "digest", "left_anti")
        some = rows.join(shared, "digest", "left_semi")
        exact = some.groupBy("digest", "content").agg(
            F.max_by("doc_id", "rank").alias("keep_id"), F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        by_content = some.join(exact, ["digest", "content"]).select(
            "digest", "row", "doc_id", "rank", F.sha2("content", 256).alias("text_sha256"), "keep_id", "best", "group_size"
        )
        joined = digests.join(own, "digest").unionByName(checkpoint(by_content))
    first = (
        joined.where(F.col("rank") == F.col("best"))
        .groupBy("text_sha256", "best")
        .agg(F.min("row").alias("row"))
        .select("row", F.lit(True).alias("first"))
    )
    return joined.join(first, "row", "left").select(
        "row", "doc_id", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"), "text_sha256"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they are identical after deleting ASCII white
    space; a null text counts as empty.  The row with the most code points in
    its original text stays, then the smallest id (null ids last).  Of repeated
    rows, equal in id and content, one stays.  Other columns are not looked at.
    An empty table gives an empty result.  ``digest`` (a function of a column)
    may be weak: documents whose digests collide are still told apart by content.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = _assigned(source, F.monotonically_increasing_id(), digest or (lambda c: F.sha2(c, 256)))
    return found.drop("row")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts, by the rule above.

    Rows are told apart by a number of their own, so rows that share an id and
    columns of any names are no trouble.
    """
    numbered, name = with_row_number(docs)
    source = numbered.select(name, F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    gone = _assigned(source, F.col(name), lambda c: F.sha2(c, 256)).where(~F.col("kept")).select(F.col("row").alias(name))
    return numbered.join(gone, name, "left_anti").select(*docs.columns)
