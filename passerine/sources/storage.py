"""Tables written between the rounds of an operator, in the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F


def new_path(spark: SparkSession) -> str:
    """A folder that is not there yet, below ``spark.checkpoint.dir``, or else in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder}/passerine-table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, read back from Parquet: lineage ends here, and a lost executor costs no earlier round."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Remove the files of a table from ``written`` that nothing will read again."""
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        deleted(df.sparkSession.sparkContext, path)


def deleted(context: SparkContext, path: str) -> None:
    """Remove a folder, with the file system that Spark reads it with."""
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: str, name: str) -> tuple[DataFrame, int]:
    """A written table of the rows with a number from 0 without gaps, in the order of a column, and how many there are.

    Ranges of the column are sorted apart, and each number is the place in its range
    plus the rows of the ranges before it, one sum for each range.
    """
    rows = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33).cast("int")
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    ahead = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    return rows.withColumn(name, (F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + ahead[part]).cast("long")), total
