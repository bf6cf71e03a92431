"""Ordered prefixes: byte budgets, skips, fixed-length chunks, and updates.

Running sums over all rows in order are made in two levels, so that no single
task holds the table: rows are dealt by range of the order, each range has a
running sum of its own, and the sums of the ranges before it are added. Ranges
are as wide as holds RANGE rows on average; where one then holds far more, rows
are dealt by their place in the order instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Width of a range of the order column.
RANGE = 100_000


def ranged(df: DataFrame, order: str, width: int = RANGE) -> DataFrame:
    """``df`` with ``__r``, which rises with an integer order and has about ``width`` rows each."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n")).first()
    if not ends["n"]:
        return df.withColumn("__r", F.lit(0).cast("bigint"))
    lo, span = int(ends["lo"]), int(ends["hi"]) - int(ends["lo"]) + 1
    step = max(1, -(-span * width // ends["n"]))
    if step < 1 << 62:
        rows = df.withColumn("__r", F.floor((F.col(order).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("bigint") if span >= 1 << 53 else F.floor((F.col(order) - lo) / step).cast("bigint"))
        # Ids are unique, so a range holds ``step`` rows at most.
        if step <= 16 * width or rows.groupBy("__r").count().agg(F.max("count")).first()[0] <= 16 * width:
            return rows
    return global_rank(df, [F.col(order)], "__place", width).withColumn("__r", F.floor(F.col("__place") / width)).drop("__place")


def running_sum(df: DataFrame, order: str, value: Column, name: str, width: int = RANGE, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, by an integer order that is unique (for each ``by``)."""
    rows = ranged(df.withColumn("__v", value.cast("bigint")), order, width)
    sums = rows.groupBy(*by, "__r").agg(F.sum("__v").alias("__s"))
    before = sums.select(*by, "__r", F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = F.sum("__v").over(Window.partitionBy(*by, "__r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__i", inner).join(before, [*by, "__r"]).withColumn(name, F.col("__b") + F.col("__i")).drop("__v", "__r", "__i", "__b")


def global_rank(df: DataFrame, order: list[Column], name: str, width: int = RANGE) -> DataFrame:
    """``df`` with each row's place from 1 in an order of all rows.

    Rows are dealt by range of the order; a row's place is its place in its
    range plus the rows of the ranges before.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    rows = scratch.cut(df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True))))
    ranges = max(1, math.ceil(rows.count() / width))
    dealt = scratch.cut(rows.repartitionByRange(ranges, *keys).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    first = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__f"))
    place = F.col("__f") + F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return dealt.join(first, "__p").withColumn(name, place).drop("__p", "__f", *keys)


def budget_prefix(docs: DataFrame, budget: int, order: str = "ord", size: Column | None = None) -> DataFrame:
    """Rows in order until the budget is reached; the row that crosses it is in."""
    size = F.octet_length("text") if size is None else size
    rows = running_sum(docs.withColumn("__size", size), order, F.col("__size"), "cum_bytes")
    return rows.filter(F.col("cum_bytes") - F.col("__size") < budget).drop("__size")


def skip_take(docs: DataFrame, skip: int, take: int, order: str = "ord") -> DataFrame:
    return docs.orderBy(order).offset(skip).limit(take)


def prompt(docs: DataFrame, chars: int, order: str = "ord") -> DataFrame:
    """One row: the first documents laid end to end, cut to exactly ``chars`` characters."""
    some = budget_prefix(docs, chars, order, F.length("text"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("text"))))
    return some.agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), ""), 1, chars).alias("prompt"))


def pack_chunks(docs: DataFrame, seq_len: int, order: str = "ord", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """Whole chunks of the stream of documents (each with an end token of 0 bytes): the documents a chunk begins and ends in.

    Works on lengths alone: the stream isn't built. Empty documents are passed over; the tail is dropped.
    """
    rows = running_sum(docs.filter(F.col(n_tokens) > 0), order, F.col(n_tokens) + 1, "stop").withColumn("start", F.col("stop") - F.col(n_tokens) - 1)
    total = rows.agg(F.floor(F.max("stop") / seq_len).alias("chunks"))
    span = rows.select(order, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / seq_len), F.floor((F.col("stop") - 1) / seq_len))).alias("chunk"))
    inside = F.least(F.col("stop"), (F.col("chunk") + 1) * seq_len) - F.greatest(F.col("start"), F.col("chunk") * seq_len)
    out = span.crossJoin(F.broadcast(total)).filter("chunk < chunks")
    return out.groupBy("chunk").agg(F.min(order).alias("first_ord"), F.max(order).alias("last_ord"), F.sum(inside).alias("n_tokens"), F.count("*").alias("n_docs"))


def chunk_bytes(tokens: DataFrame, seq_len: int) -> DataFrame:
    """Exact bytes of each whole chunk. ``tokens``: pos (gapless from 0) and n_bytes."""
    out = tokens.groupBy(F.floor(F.col("pos") / seq_len).alias("chunk")).agg(F.count("*").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))
    return out.filter(F.col("n_tokens") == seq_len)


def bytes_at(docs: DataFrame, marks: DataFrame, seq_len: int, order: str = "ord", lengths: str = "token_bytes") -> DataFrame:
    """(n, bytes): raw bytes of the first ``n`` tokens of the stream of documents, for each mark; null beyond its whole chunks.

    The stream is each document's tokens and an end token of 0 bytes; empty
    documents are passed over. A mark meets the one document that holds it.
    """
    size = F.size(lengths)
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = docs.filter(size > 0).select(order, lengths, (size + 1).cast("bigint").alias("__t"), add(F.col(lengths)).alias("__w"))
    rows = running_sum(running_sum(rows, order, F.col("__t"), "__tok"), order, F.col("__w"), "__bytes")
    last = rows.agg((F.floor(F.max("__tok") / seq_len) * seq_len).alias("__full"))
    # Blocks of tokens: a document is in the blocks that it touches.
    block = 1 << 16
    spans = rows.withColumn("__from", F.col("__tok") - F.col("__t")).withColumn("__k", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__tok") - 1) / block))))
    asked = marks.select("n").distinct().withColumn("__k", F.floor((F.col("n") - 1) / block))
    hit = asked.join(spans, "__k").filter((F.col("__from") < F.col("n")) & (F.col("n") <= F.col("__tok")))
    inside = F.col("__bytes") - F.col("__w") + add(F.slice(lengths, 1, F.least(F.col("n") - F.col("__from"), F.size(lengths)).cast("int")))
    found = hit.select("n", inside.alias("__b"))
    out = asked.join(found, "n", "left").crossJoin(F.broadcast(last))
    return out.select("n", F.when(F.col("n") <= 0, F.lit(0)).when(F.col("n") <= F.col("__full"), F.col("__b")).cast("bigint").alias("bytes"))


def updates(chunks: DataFrame, micro: int, accumulate: int, budget: int) -> DataFrame:
    """Observed and applied bytes when training stops at the first update that reaches the budget."""
    step = micro * accumulate
    by = chunks.groupBy(F.floor(F.col("chunk") / step).alias("update")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_chunks"))
    run = running_sum(by.filter(F.col("n_chunks") == step), "update", F.col("n_bytes"), "cum_bytes")
    stop = run.filter(F.col("cum_bytes") >= budget).agg(F.min("update").alias("last"))
    return run.crossJoin(F.broadcast(stop)).filter(F.col("update") <= F.coalesce("last", "update")).select("update", "n_bytes", "cum_bytes")


def scored_bytes(docs: DataFrame, seq_len: int, lengths: str = "token_bytes") -> DataFrame:
    """By document: all bytes, bytes of scored tokens, of first tokens, of tails too short to score, and chunks."""
    n = F.size(lengths)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(seq_len))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.slice(lengths, i + 1, seq_len))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    long_, short = F.filter("__c", lambda c: F.size(c) >= 2), F.filter("__c", lambda c: F.size(c) < 2)
    rows = docs.withColumn("__c", chunks)
    return rows.select(
        *[c for c in docs.columns if c != lengths],
        add(F.col(lengths)).alias("total_bytes"),
        add(F.flatten(F.transform(long_, lambda c: F.slice(c, 2, seq_len)))).alias("scored_bytes"),
        add(F.transform(long_, lambda c: c[0])).alias("first_bytes"),
        add(F.flatten(short)).alias("dropped_bytes"),
        F.size("__c").alias("n_chunks"),
    )
