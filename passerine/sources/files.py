"""Files as tables: detection logs, documents, registries; and what is written beside them.  Audio is in ``audio``."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .audio import read_audio  # noqa: F401  (it belongs to this module's functions)

#: A record that has one field or none.
_ONE_FIELD = r'^\s*("([^"]|"")*"|[^,"]*)\s*$'


def _headers(spark: SparkSession, paths: list[str], options: dict) -> list[tuple[list[str], list[str]]]:
    """Column names and the files that have them, in this order; only the first lines of the files are read."""
    first = spark.read.options(pathGlobFilter="*.csv", recursiveFileLookup=options["recursiveFileLookup"], wholetext=False).text(paths)
    # a file's first line lies in the split that starts at its beginning
    start = first.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("line")).where("at = 0")
    heads = start.groupBy("file").agg(F.min_by("value", "line").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    found: dict[tuple[str, ...], list[str]] = {}
    for head, files in heads:
        names = next(csv.reader([head.lstrip("\ufeff")]), [])
        found.setdefault(tuple(n.strip() for n in names), []).extend(files)
    return sorted(((list(n), sorted(f)) for n, f in found.items() if n), key=lambda x: x[1])


def read_csv(spark: SparkSession, *paths: str, recursive: bool = False, folder: str | None = None) -> DataFrame:
    """CSV files, each with a header of its own, all columns text, with source_csv (path) and source_row (its order inside a file).

    Every file's columns go by its own header, so files may have theirs in any
    order; the table has the columns of all files, those of the first file first,
    and a column that a file lacks is the empty text in its rows.  Quoted fields may
    hold commas, line ends and doubled quotes (a header may not hold line ends); a
    byte order mark is taken off; a missing cell is the empty text; records of one
    field or none are dropped.  ``recursive`` looks into all folders below the paths;
    with ``folder`` only files right inside a folder of that name, in any case, count.
    Files of equal names in several folders all count.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "encoding": "UTF-8", "enforceSchema": True}
    kinds = _headers(spark, list(paths), {"recursiveFileLookup": recursive})
    if folder is not None:
        inside = re.compile(f"(?i)/{re.escape(folder)}/[^/]+$")
        kinds = [(names, kept) for names, files in kinds if (kept := [f for f in files if inside.search(f)])]
    columns = list(dict.fromkeys(n for names, _ in kinds for n in names))
    out = None
    for names, files in kinds:
        # a name that comes twice in one header is known by its first place
        given = [n if names.index(n) == k else f"_again{k}" for k, n in enumerate(names)]
        schema = ", ".join(f"`{c}` string" for c in [*given, "_bad"])
        rows = spark.read.options(**options).schema(schema).option("columnNameOfCorruptRecord", "_bad").csv(files)
        cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns]
        full = rows.select(*cells, "_bad", F.col("_metadata.file_path").alias("source_csv"), F.monotonically_increasing_id().alias("source_row"))
        full = full.where(F.col("_bad").isNull() | ~F.col("_bad").rlike(_ONE_FIELD)).drop("_bad")
        out = full if out is None else out.unionByName(full)
    if out is None:
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), "source_csv string, source_row long"]))
    return out


def file_paths(spark: SparkSession, path: str, pattern: str, test: Column | None = None) -> DataFrame:
    """path of every file below ``path`` whose name fits the pattern and whose path passes the test; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    return found if test is None else found.where(test)


def basename_index(paths: DataFrame) -> DataFrame:
    """audio_id (name without folders and extension), local_audio_path; of equal names the last path counts."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return paths.groupBy(name.alias("audio_id")).agg(F.max("path").alias("local_audio_path"))


def with_audio(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows whose recording has a file, with its path."""
    return rows.join(index, "audio_id")


def eligible(model: str, least: float = 0.5) -> Column:
    """Is a detection of this model and surer than ``least``?  Texts that are no number and NaN are not."""
    sure = F.expr("try_cast(confidence as double)")
    return F.coalesce((F.lower(F.trim(F.coalesce(F.col("model"), F.lit("")))) == model) & (sure > least) & ~F.isnan(sure), F.lit(False))


def manifest(detections: DataFrame, model: str, keys: Sequence[str], order: Sequence[str], least: float = 0.5) -> DataFrame:
    """The surest eligible detection of each key; of equally sure ones the first in ``order``."""
    from ..operators.select import best_by

    rows = detections.where(eligible(model, least)).withColumn("_sure", F.expr("try_cast(confidence as double)"))
    return best_by(rows, list(keys), "_sure", list(order)).drop("_sure")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column] = ()) -> None:
    """One CSV file with a header and the columns in this order; only fields that need quotes get them."""
    rows = df.orderBy(*order) if order else df
    rows.select(*columns).coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table unless it is there whole; whether it was written.

    The table is there if its folder has the ``_SUCCESS`` of a finished write.  It is
    written beside and then renamed, so a reader never sees half of it; what a
    crashed write has left is taken away.  Of two writers at once the first one wins.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = hadoop(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda: fs.exists(hadoop(path, "_SUCCESS"))
    if done():
        return False
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(beside)
    if not done() and fs.exists(where):
        fs.delete(where, True)
    if not done() and fs.rename(hadoop(beside), where) and not fs.exists(hadoop(path, beside.rpartition("/")[2])):
        return True
    fs.delete(hadoop(beside), True)
    fs.delete(hadoop(path, beside.rpartition("/")[2]), True)
    return False


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that has the counters once an action on it has run."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one or a list of them in a file, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry's entries; none if the file is missing or is no JSON."""
    try:
        return spark.read.schema(schema).options(multiLine=True, mode="DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def argument(argv: Sequence[str], name: str, fallback: str) -> str:
    """Value of ``--name=value``, the first one, else the fallback."""
    return next((a.partition("=")[2] for a in argv if a.startswith(f"--{name}=")), fallback)


def preferred(rows: DataFrame, tests: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """One row: the first in order of those that pass the first test that any row passes."""
    rank = F.lit(len(tests))
    for k, test in reversed(list(enumerate(tests))):
        rank = F.when(test, F.lit(k)).otherwise(rank)
    ranked = rows.withColumn("_rank", rank).where(F.col("_rank") < len(tests))
    return ranked.orderBy("_rank", *order).limit(1).drop("_rank")
