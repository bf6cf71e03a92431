"""Token counts through a cache keyed by content and tokenizer digests.

A text's key is the sha256 of its normalised content; the tokenizer's version is
the sha256 of its vocabulary file. Keys that the cache table lacks for this
version are encoded, each distinct content once, and appended to the table; all
rows then get their counts from the table by a join. Texts are deduplicated
before they are encoded, so copies are neither moved nor encoded twice; AQE
splits the join of a content that a large part of the rows share.

The byte-level vocabulary has no normaliser: normalised content is the text,
with null as the empty text. Where a tokenizer drops distinctions, pass a
``normalise`` expression that drops the same ones.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
get a row each. A digest that the cache holds more than once (two writers, a job that
was repeated) counts once, with the least count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "digest binary, n_tokens bigint, version string"
LIMIT = 512


def cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the table holds for a tokenizer version."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], SCHEMA)
    return rows.filter(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``docs`` (doc_id, text) with n_bytes and n_tokens; the cache table at ``path`` grows by the misses."""
    spark = docs.sparkSession
    common.prepare(spark)
    version = tokens.version(vocabulary)
    content = F.coalesce(normalise(F.col("text")), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([z.compress(t) for t in common.raw_texts(b)], pa.binary())], names=["digest", "packed"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, z = tokens.worker_wide(("counts", vocabulary), lambda: tokens.ByteCounts(vocabulary)), zstandard.ZstdDecompressor()
        for b in batches:
            n = [counts.count(z.decompress(t)) for t in b.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    # Only the scan of texts, the digests and the packed distinct texts come
    # before the encoder; the cache side of the anti join holds digests alone.
    rows = docs.select(digest.alias("digest"), content.alias("text")).mapInArrow(packed, "digest binary, packed binary")
    misses = rows.groupBy("digest").agg(F.first("packed").alias("packed")).join(cached(spark, path, version), "digest", "left_anti")
    misses.mapInArrow(encoded, "digest binary, n_tokens bigint").withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    # A digest may have been appended twice (two writers, a repeated job): one row of it.
    known = common.cut(cached(spark, path, version).groupBy(F.col("digest").alias("__digest")).agg(F.min("n_tokens").alias("n_tokens")))
    out = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), digest.alias("digest"))
    return out.join(known, F.col("digest") == F.col("__digest"), "left").select("doc_id", "n_bytes", "n_tokens")


def op4_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Counts of all documents, by way of the cache table at ``path`` or, without one, a new table in the shared folder."""
    common.prepare(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"
    rows = count_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)
