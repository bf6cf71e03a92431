"""Writers: manifests and corpora by split, summaries, hashes of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def manifest(docs: DataFrame) -> DataFrame:
    """Manifest rows of split documents (doc_id, source, domain, date, language, text, split)."""
    text = F.col("text")
    date = F.coalesce(F.nullif(F.substring("date", 1, 10), F.lit("")), F.lit(schemas.MISSING))
    own = {"date": date, "sha256": F.sha2("text", 256), "char_count": F.length(text), "byte_count": F.octet_length(text), "latin_share": F.round(T.latin_share(text), 4), "hangul_ratio": F.round(T.ratio(text, T.HANGUL), 4)}
    return docs.select(*(own.get(c, F.col(c)).alias(c) for c in schemas.TABLES["manifest"]))


def write_by_split(df: DataFrame, path: str, order: str = "doc_id", files_per_split: int = 1) -> None:
    """Parquet by split, sorted inside each file; more files a split for large data."""
    part = df if files_per_split == 1 else df.withColumn("__f", F.pmod(F.xxhash64(order), F.lit(files_per_split)))
    keys = ["split"] + ["__f"] * (files_per_split > 1)
    part.repartition(*keys).sortWithinPartitions(*keys, order).drop("__f").write.partitionBy("split").mode("overwrite").parquet(path)


def write_jsonl(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "domain", "text", "split").write.partitionBy("split").mode("overwrite").json(path)


def summary(rows: DataFrame) -> DataFrame:
    """Documents, characters and bytes by split and domain."""
    return rows.groupBy("split", F.coalesce("domain", F.lit(schemas.MISSING)).alias("domain")).agg(F.count("*").alias("n_docs"), F.sum("char_count").alias("n_chars"), F.sum("byte_count").alias("n_bytes"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("nullValue", schemas.MISSING).option("emptyValue", schemas.MISSING).csv(path)
