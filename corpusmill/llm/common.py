"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..scratch import release
from ..spread import spread

__all__ = ["cut", "fold", "labelled_sample", "labelled_texts", "let", "prepare", "raw_texts", "release", "table", "texts", "with_columns"]

#: Rows of one Arrow batch. Texts can be long, so batches are kept short.
BATCH_ROWS = 256

# Workers get this package's functions inside the pickled task, so that it
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark opens the path. The tables of texts are dealt over all cores if they are small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches, and a checkpoint folder where none is set (tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    scratch.folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """A written table in the shared checkpoint folder: lineage ends here."""
    prepare(df.sparkSession)
    return scratch.cut(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def labelled_sample(labels: DataFrame, label: str, train: F.Column, per_class: int) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` ids of each class, in hash order of the id.

    An id has one row; one with both labels has none, and null labels don't count.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & train & F.col("label").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("__most")).filter("label = __most").drop("__most")
    parts = [rows.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, per_class: int) -> DataFrame:
    """(label, text) of the sample: one row an id, of a repeated id the least text (null: empty).

    This is the documented bound on what a classifier here is fitted on:
    ``2 * per_class`` rows, however often an id occurs. Scores, counts and
    statistics elsewhere use all rows.
    """
    sample = labelled_sample(labels, label, train, per_class)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column's strings as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def with_columns(df: DataFrame, added: list[tuple[str, T.DataType]], values: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: Callable[[pa.RecordBatch], pa.Array] | None = None) -> DataFrame:
    """``df`` with columns that Python computes batch by batch.

    ``values()`` is called once a task and gives the function of a batch. A
    column of ``df`` that has the name of an added one is replaced.
    """
    names = {n for n, _ in added}
    base = df.drop(*names)
    schema = T.StructType(base.schema.fields + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = values()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *f(b)], names=[*b.schema.names, *(n for n, _ in added)])

    return base.mapInArrow(run, schema)
