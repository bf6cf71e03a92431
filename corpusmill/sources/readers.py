"""Readers: strided Parquet row groups, several files with fallback ids, TSV without quotes, corpora, items."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import budget


def spacing(total: int, max_docs: int, shards: int, per_group: int = 1000) -> tuple[int, int]:
    """How many of ``total`` row groups hold one shard's part of ``max_docs``, and how far apart they are."""
    want = math.ceil(math.ceil(max_docs / per_group) / shards)
    return want, max(1, total // want) if want else 1


def stride(total: int, max_docs: int, shards: int, per_group: int = 1000) -> list[int]:
    """Numbers of the evenly spaced row groups of one shard that hold its part of ``max_docs``."""
    want, step = spacing(total, max_docs, shards, per_group)
    return list(range(0, total, step))[:want]


def pick_files(paths: list[str], files: int) -> list[str]:
    """Evenly spaced files of a sorted list."""
    paths = sorted(paths)
    return paths[:: max(1, len(paths) // files)][:files] if files else []


def list_parquet(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Parquet files below a folder whose names start with a prefix, sorted; listed by Spark's file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        p = found.next().getPath()
        if p.getName().startswith(prefix) and p.getName().endswith(".parquet"):
            out.append(p.toString())
    return sorted(out)


def read_documents(spark: SparkSession, paths: list[str], columns: list[str], text: str = "text") -> DataFrame:
    """The wanted columns that the files have, each row's file, and a fallback id (file and row number)."""
    if not paths:
        raise ValueError("no files to read")
    df = spark.read.parquet(*paths)
    own = [c for c in columns if c in df.columns]
    meta = F.col("_metadata")
    return df.select(*own, meta["file_path"].alias("_source_path"), F.concat(meta["file_path"], F.lit("#"), meta["row_index"].cast("string")).alias("_fallback_id")).filter(F.col(text).isNotNull() if text in own else F.lit(True))


def numbered(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The wanted columns of a table as it was read with ``_row``, and how many rows there are.

    Rows are numbered from 0 through all files in the order of their paths. The
    reader's own number begins anew in each file; the rows of the files before are
    added. One pass counts the rows of each file.
    """
    meta = F.col("_metadata")
    sizes = sorted(tuple(r) for r in df.groupBy(meta["file_path"]).count().collect())
    first = list(itertools.accumulate((n for _, n in sizes), initial=0))
    files = df.sparkSession.createDataFrame([(f, n) for (f, _), n in zip(sizes, first[:-1], strict=True)], "_file string, _first long")
    rows = df.select(*columns, meta["file_path"].alias("_file"), meta["row_index"].alias("_index"))
    return rows.join(F.broadcast(files), "_file").select(*columns, (F.col("_first") + F.col("_index")).alias("_row")), first[-1]


def strided(spark: SparkSession, path: str, columns: list[str], max_docs: int, shards: int = 1, per_group: int = 1000, max_bytes: int | None = None, text: str = "text", row: str | None = None) -> DataFrame:
    """Rows in evenly spaced stretches of ``per_group`` rows of a Parquet table of one or many files.

    The row number is the integer column ``row``, or else the reader's own, counted
    through all files by path. Only the wanted columns are decoded and no order is
    assumed between tasks. With ``max_bytes`` rows are taken in order until their
    texts reach the budget; the row that crosses it is in.
    """
    if max_bytes is not None:
        some = strided(spark, path, [*dict.fromkeys([*columns, text])], max_docs, shards, per_group, row=row)
        size = F.coalesce(F.octet_length(text), F.lit(0))
        return budget.budget_prefix(some, max_bytes, "_row", size).select(*columns, "_row")
    df = spark.read.parquet(path)
    rows, total = numbered(df, columns) if row is None else (df.select(*columns, F.col(row).alias("_row")), df.count())
    want, step = spacing(math.ceil(total / per_group), max_docs, shards, per_group)
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    g = div(F.col("_row"), per_group)
    return rows.filter((g % step == 0) & (div(g, step) < want) & F.lit(want > 0))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV file whose fields may hold quotes: none is special."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table: text columns in their fixed order, NA as null."""
    return spark.read.schema(schemas.text_schema(table)).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("nullValue", schemas.MISSING).csv(path)


def read_corpus(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """A split's JSON lines with those of its controls; none is an error."""
    return spark.read.schema("doc_id string, domain string, text string").json([f"{folder}/{split}.jsonl", f"{folder}/{split}_control_*.jsonl"]).filter("text is not null")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice items; answers 1 to 4 become 0 to 3, others raise."""
    need = ["question", "A", "B", "C", "D", "answer"]
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    answer = F.col("answer").try_cast("int")
    checked = F.when(answer.between(1, 4), answer - 1).otherwise(F.raise_error(F.concat(F.lit("answer out of 1 to 4: "), F.col("answer"))))
    return df.select(*need[:-1], checked.alias("gold"))


def named_corpora(corpora: dict[str, DataFrame | str], spark: SparkSession | None = None) -> DataFrame:
    """Union of corpora with their language; a corpus given as a path of JSON lines that isn't there is passed over."""
    out = None
    for lang, df in corpora.items():
        if isinstance(df, str):
            path = spark._jvm.org.apache.hadoop.fs.Path(df)
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                continue
            df = spark.read.schema("doc_id string, domain string, text string").json(df)
        df = df.withColumn("lang", F.lit(lang))
        out = df if out is None else out.unionByName(df)
    return out
