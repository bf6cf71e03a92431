"""Cleaning and packing of the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.

An empty table gives an empty one in every stage. Nulls: a null text is judged as
the empty text by the classifiers, is linked with nothing, holds no window, and
is packed as its end id; rows with a null id stay until they are packed. Rows
that repeat an id are judged one by one, and the near-duplicate stage leaves one
of them. Ties go to the smaller id, and of one id to the lesser text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import common, decontaminate, neardup, packing, quality_knn, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go; without labels of both kinds nothing does, unless all are toxic."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.3 go; without labels the score is 0.5 and all stay."""
    return quality_knn.keep_good(docs, common.table(spark, sf_dir, "labels"))


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the smallest id stays; documents without words all do."""
    return neardup.drop_copies(docs, shingle=5, threshold=0.8)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty items have none."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"), what="documents")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("neardup", stage_neardup),
    ("decontaminate", stage_decontaminate),
    ("packing", stage_packing),
]

#: The trained stages can't be written in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
