"""Written tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables written by this process and not yet deleted.
WRITTEN: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The checkpoint folder; one is made only where none is set and all runs in one process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusmill-ckpt-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Written as a table under the shared checkpoint folder and read back.

    Lineage ends here, and what is lost with an executor is read again. Unlike
    a checkpoint, a table has the sizes that the optimizer needs: those that it
    derives over loops of joins grow without end.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/corpusmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    WRITTEN.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    WRITTEN.discard(path)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_corpusmill_path", None):
            _delete(t.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all tables that were written: for use once results are stored elsewhere."""
    for path in list(WRITTEN):
        _delete(spark, path)
