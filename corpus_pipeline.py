"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

Every stage works on all rows that its predecessor kept; all but the last return
the columns of documents.  SQL can't express the language and near-dedup stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passerine.llm import decontaminate, exact_dedup, langid, mixing, near_dedup
from passerine.llm.common import checkpoint, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", deduplicate),
    ("simhash_near_dedup", near_deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
