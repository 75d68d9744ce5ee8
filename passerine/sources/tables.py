"""Readers of tables, detection logs and label lists, and a writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, *paths: str) -> DataFrame:
    """Detection logs: CSV with a header, all strings, quoted line ends allowed; confidence, start and end as numbers."""
    rows = spark.read.csv(list(paths), header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in ("confidence", "start_time", "end_time") if c in rows.columns}
    return rows.withColumns(numbers)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'Scientific name_Common name' with id, their place in the file; without '_' the one name is both.

    Only what stands between the first '_' and a second one is the common name.
    """
    line = F.regexp_replace(F.trim("value"), "\r$", "")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split(F.col("value"), "\n"), lambda x: F.trim(x) != "")).alias("id", "value"))
    parts = F.split(line, "_")
    return rows.select("id", F.get(parts, F.lit(0)).alias("scientific_name"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).alias("common_name"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, order: Sequence[Column] = (), single: bool = False) -> None:
    """One pretty-printed JSON file: a list of the rows in this order, or with ``single`` the only row as an object.

    Null fields are left out.  The file is written beside and then takes the place of
    the one before, so a reader sees a whole document.  The text passes through one
    task as a stream, as one file is asked; the order is made by all tasks.
    """
    spark = df.sparkSession
    rows = df.orderBy(*order) if order else df
    texts = rows.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for batch in batches:
            lines = [("," if some or n else "[") + text for n, text in enumerate(batch.column(0).to_pylist())]
            some = some or bool(lines)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if some else "[]"])], names=["value"])

    if single and df.limit(2).count() != 1:
        raise ValueError("a single document is one row")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    (texts if single else texts.mapInArrow(listed, "value string")).write.text(beside)
    parts = [f.getPath() for f in fs.listStatus(hadoop(beside)) if f.getPath().getName().startswith("part-") and f.getLen()]
    if not parts:  # a table without partitions has no task that could write
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(beside)
        parts = [f.getPath() for f in fs.listStatus(hadoop(beside)) if f.getPath().getName().startswith("part-") and f.getLen()]
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(path), True)
    fs.rename(parts[0], hadoop(path))
    fs.delete(hadoop(beside), True)
