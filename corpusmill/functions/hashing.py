"""Hashes: SHA-2 natively, keyed BLAKE2b buckets by Arrow UDF."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blake2b_unit(bits: int = 64):
    """Arrow UDF: BLAKE2b of the text as a number in [0, 1)."""

    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=bits // 8).digest(), "big") / 2.0**bits)

    return f


def sha256_unit(text: Column) -> Column:
    """The first 52 bits of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def dataset_hash(rows: DataFrame, sha256: str, key: str) -> DataFrame:
    """One row: SHA-256 over the hashes of 4,096 parts in order; a part's is over its rows' hashes in the order of their keys.

    A row's part is the beginning of its key's own hash, so parts grow evenly.
    """
    part = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3)
    joined = lambda a: F.sha2(F.array_join(F.transform(a, lambda x: x["h"]), ""), 256)
    parts = rows.groupBy(part.alias("k")).agg(joined(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(sha256).alias("h"))))).alias("h"))
    return parts.agg(joined(F.sort_array(F.collect_list(F.struct("k", "h")))).alias("dataset_hash"))


def text_hash(text: Column) -> Column:
    """SHA-256 of a text whose CRLF line ends count as LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def file_hashes(spark: SparkSession, path: str, skip: tuple[str, ...] = ("__pycache__",)) -> DataFrame:
    """(name, sha256, size_bytes) of the files below a folder, or of one file; names are relative, with slashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(root).toUri().getPath().rstrip("/")
    own = F.regexp_replace(F.col("path"), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    folder = fs.getFileStatus(root).isDirectory()
    name = F.substr(own, F.lit(len(whole) + 2)) if folder else F.element_at(F.split(own, "/"), -1)
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    return rows.filter(~F.arrays_overlap(F.split("name", "/"), F.array(*map(F.lit, skip)))) if skip else rows


def folder_hash(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the names and hashes of ``file_hashes`` in the order of names, and the bytes of all.

    A folder's listing meets in one row: tens of bytes a file.
    """
    listed = F.sort_array(F.collect_list(F.struct("name", "sha256")))
    lines = F.array_join(F.transform(listed, lambda x: F.concat(x["name"], F.lit("  "), x["sha256"])), "\n")
    return files.agg(F.sha2(lines, 256).alias("sha256"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def object_hash(value: object) -> str:
    """SHA-256 of an object's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
