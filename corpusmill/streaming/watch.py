"""Streams over appended tables: alerts, incremental deduplication, stable splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup


def failures(ledger: DataFrame, words: tuple[str, ...] = ("out of memory", "nan", "killed")) -> DataFrame:
    """Failed or aborted rows, and rows whose note has a fatal word; works on batches and streams."""
    note = F.lower(F.coalesce("note", F.lit("")))
    fatal = F.lit(False)
    for w in words:
        fatal = fatal | note.contains(w)
    return ledger.filter(F.col("status").isin("fail", "abort") | fatal).select("ts_utc", "run_id", "status", "note")


def watch(spark: SparkSession, path: str, schema) -> DataFrame:
    """Alerts of rows as they are appended to a Parquet table."""
    return failures(spark.readStream.schema(schema).parquet(path))


def stalls(activity: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions of each run's activity; one ends when nothing came for so long. ``activity`` has a watermark on ts."""
    return activity.groupBy("run_id", F.session_window("ts", f"{minutes} minutes")).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("run_id", "session_window.start", "session_window.end", "n", "last")


def new_contents(docs: DataFrame) -> DataFrame:
    """Each content once over the life of a stream (which copy comes first isn't fixed)."""
    return docs.withColumn("sha256", F.sha2("text", 256)).dropDuplicates(["sha256"])


def host_cap(docs: DataFrame, cap: int, host: str = "host") -> DataFrame:
    """The first ``cap`` rows of each host over the life of a stream, in order of arrival (which isn't fixed between tasks).

    Each host keeps one number as state; rows without a host aren't capped. The
    two outputs are streams of their own and are combined by a union.
    """
    schema = docs.schema
    names = [f.name for f in schema.fields]

    def keep(key, batches, state):
        seen = state.get[0] if state.exists else 0
        for b in batches:
            part = b.iloc[: max(0, cap - seen)]
            seen += len(part)
            if len(part):
                yield part[names]
        state.update((seen,))

    blank = F.coalesce(F.col(host), F.lit("")) == ""
    named = docs.filter(~blank).groupBy(host).applyInPandasWithState(keep, schema, "n long", "append", "NoTimeout")
    return named.unionByName(docs.filter(blank))


def split(docs: DataFrame) -> DataFrame:
    """Splits of a stream's documents: a row's split depends on its id alone."""
    return docs.withColumn("split", dedup.hash_split_sha256(F.col("doc_id")))
