"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Files of so many bytes in all are worth dealing out, and cheap to.
LEAST_BYTES, MOST_BYTES = 1 << 20, 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, dealt over all cores if it is small and lies in fewer files than there are cores.

    A Parquet row group is read by one task, so a small file keeps one core busy
    however much is computed from it. Moving MOST_BYTES at most costs less. Larger
    tables, and tables of many files, are left as they are.
    """
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not LEAST_BYTES <= size <= MOST_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
