"""Sharding: a seeded global shuffle in two passes over external storage, cut into shards of equal row counts.

The first pass scatters the rows uniformly into buckets that fit in memory, by a
seeded hash of each row's number; the second one shuffles every bucket by Fisher
and Yates and writes it.  A bucket's place in the whole order is the sum of the
counts before it, so no row is ever ordered against all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import free_name, with_row_number

#: Bytes of text that a bucket holds about: what one task shuffles in memory.
BUCKET_BYTES = 32 << 20
#: What a row counts beside its text, in bytes.
OVERHEAD = 8
#: Buckets whose counts are added up together in the prefix sum.
SPAN = 1024


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0 to n - 1: from the last place on, each is swapped with a random one that is not behind it."""
    draws = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), bucket])).random(max(0, n - 1))
    places = (draws * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), places, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _offsets(counts: DataFrame) -> DataFrame:
    """bucket, before: rows in the buckets before it; sums inside spans of buckets and sums of spans, so no task orders all."""
    spans = counts.groupBy(F.floor(F.col("bucket") / SPAN).alias("span")).agg(F.sum("n").alias("m"))
    ahead = spans.select("span", (F.sum("m").over(W.orderBy("span")) - F.col("m")).alias("ahead"))
    inside = W.partitionBy("span").orderBy("bucket")
    each = counts.withColumn("span", F.floor(F.col("bucket") / SPAN)).withColumn("inside", F.sum("n").over(inside) - F.col("n"))
    return each.join(ahead, "span").select("bucket", (F.col("ahead") + F.col("inside")).alias("before"))


def shuffled(docs: DataFrame, shards: int = 24, seed: int = 0, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard (int, from 0) and slot (long, gapless from 0 in each shard) of one global shuffle.

    The counts of two shards differ by one row at most, so shards are empty only if
    there are fewer rows than shards.  Rows are told apart by their number in the
    table, so repeated rows, ties and null ids are dealt out like any others and no
    group of copies meets in one bucket; a null text counts as empty.  A text longer
    than a bucket makes that bucket as long as it is.  The same table, read in the
    same parts, gives the same order for a seed.  A column of ``docs`` that is called
    shard or slot keeps its name; the new one then gets an underscore.
    """
    rows, number = with_row_number(docs)
    shard, bucket = free_name(docs, "shard"), free_name(rows, "bucket")
    slot = free_name(docs, "slot")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    whole = rows.agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).first()
    total, buckets = whole["n"], max(shards, -(-(whole["size"] or 0) // bucket_bytes))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.col(number)), F.lit(buckets)).cast("long"))
    before = _offsets(dealt.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    names = docs.columns

    def shuffle(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({**{c: left.column(c) for c in names}, shard: pa.array([], pa.int32()), slot: pa.array([], pa.int64())})
        number_of = left.column(bucket)[0].as_py()
        order = np.argsort(left.column(number).to_numpy(), kind="stable")[fisher_yates(left.num_rows, seed, number_of)]
        place = right.column("before")[0].as_py() + np.arange(left.num_rows)
        of = place * shards // total
        return left.select(names).take(pa.array(order)).append_column(shard, pa.array(of, pa.int32())).append_column(slot, pa.array(place - -(-of * total // shards), pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{shard}` int, `{slot}` long"
    return dealt.groupBy(bucket).cogroup(before.groupBy("bucket")).applyInArrow(shuffle, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 0, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``shuffled``, written as one folder for each shard, its files in the order of their slots; what was written, as a table.

    A task writes the buckets it has shuffled and nothing else, so a lost executor
    costs its buckets only.
    """
    out = shuffled(docs, shards, seed, text_col, bucket_bytes)
    shard, slot = out.columns[-2:]
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)
