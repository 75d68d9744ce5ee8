"""A table kept by a stream: one folder of changes for each micro-batch, merged when read.

A batch is written to a folder with its own number.  A batch that runs again after a
failure has the same number and the same rows, so it replaces what it left; only
folders with the ``_SUCCESS`` of a finished write are read.  So the table never
holds a row twice, and no earlier row is rewritten to take in a new batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

_BATCH, _BASE = "batch-", "base-"


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch's rows, with their number as ``batch``, once however often it is run."""

    def write(rows: DataFrame, number: int) -> None:
        out = rows.withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/{_BATCH}{number:019d}")

    return write


def _parts(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names of the folders that are whole and count, and of those that a later base has taken in."""
    fs, where = _folder(spark, path)
    if not fs.exists(where(path)):
        return [], []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where(path)))
    whole = [n for n in names if fs.exists(where(f"{path}/{n}", "_SUCCESS"))]
    base = max((n for n in whole if n.startswith(_BASE)), default="")
    upto = base.removeprefix(_BASE)
    live = [n for n in whole if n == base or n.startswith(_BATCH) and n.removeprefix(_BATCH) > upto]
    old = [n for n in whole if n not in live and n.startswith((_BASE, _BATCH))]
    return live, old


def changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every change of the finished batches, with ``batch``; none if there is no batch yet."""
    full = f"{schema}, batch long"
    live, _ = _parts(spark, path)
    return spark.read.schema(full).parquet(*[f"{path}/{n}" for n in live]) if live else spark.createDataFrame([], full)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row that the last batch has for each key, with its ``batch``; keys are unique in a batch, null is a key."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*keys, *[F.col("_l")[c].alias(c) for c in rest])


def compacted(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Merge the finished batches into one base, then remove what it took in; how many folders went.

    ``merge`` gives the changes that are still needed, ``batch`` included.  A crash
    before the base is whole changes nothing, one after it leaves folders that are
    not read and that the next call removes.
    """
    live, _ = _parts(spark, path)
    if len(live) > 1:
        number = live[-1].removeprefix(_BATCH)
        out = merge(changes(spark, path, schema))
        out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/{_BASE}{number}")
    fs, where = _folder(spark, path)
    _, old = _parts(spark, path)
    for name in old:
        fs.delete(where(f"{path}/{name}"), True)
    return len(old)


def started(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The stream of changes to the table at ``path``, running over all that is there now."""
    return rows.writeStream.foreachBatch(appended(path)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
