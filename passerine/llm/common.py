"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space, the separators of every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A null id sorts after every other one.
LAST_ID = 2**63 - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def word_tokens(data: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text, as bytes."""
    return data.translate(WORD_BYTES).split()


def new_path(spark) -> str:
    """A folder that is not there yet, in the shared folder that the session names."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder}/passerine-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder that the session names.

    Rows are columnar and compressed there, a third or less of what a checkpoint
    of the same rows takes.  The shuffles behind it go when it is written.
    ``release`` removes a table that is read no more; the last ones, which a
    result still reads, are left in the folder, which is the caller's to clear.
    Without a named folder the tables lie beside the session's own, in the warehouse.
    """
    spark = df.sparkSession
    path = new_path(spark)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: dict[int, tuple] = {}


def release(*tables: DataFrame) -> None:
    """Remove tables that ``checkpoint`` wrote and that nothing will read again."""
    for table in tables:
        _, path = _paths.pop(id(table))
        jvm = table.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as it takes to be no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_row_number(df: DataFrame) -> tuple[DataFrame, str]:
    """A table of the rows with a number of their own, written once so that it stays, and that column's name."""
    name = free_name(df, "row_number")
    return checkpoint(df.withColumn(name, F.monotonically_increasing_id())), name
