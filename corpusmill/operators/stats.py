"""Aggregates and resampling for reports. Ratios are ratios of sums; undefined is null."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Fixed value: two-sided 95% quantile of Student's t with two degrees of freedom.
T_DF2 = 4.302653


def compression(docs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of documents, characters, bytes, words and tokens, and their ratios."""
    s = lambda c: F.sum(c)
    out = docs.groupBy(*by).agg(F.count("*").alias("n_docs"), s("n_chars").alias("n_chars"), s("n_bytes").alias("n_bytes"), s("n_words").alias("n_words"), s("n_tokens").alias("n_tokens"))
    ratios = {"tok_per_char": ("n_tokens", "n_chars"), "tok_per_byte": ("n_tokens", "n_bytes"), "bytes_per_tok": ("n_bytes", "n_tokens"), "tok_per_word": ("n_tokens", "n_words")}
    return out.select("*", *(F.try_divide(a, b).alias(k) for k, (a, b) in ratios.items()))


def length_percentiles(docs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Whole parts of interpolated percentiles, and the maximum."""
    out = percentiles(docs.filter(F.col(value).isNotNull()), by, value, {"p50_len": 0.5, "p90_len": 0.9, "p95_len": 0.95, "p99_len": 0.99, "max_len": 1.0})
    return out.select(*by, *(F.floor(n).alias(n) for n in ("p50_len", "p90_len", "p95_len", "p99_len")), F.col("max_len").cast(docs.schema[value].dataType).alias("max_len"))


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    """From sums."""
    return F.try_divide(nll, F.ln(F.lit(2.0)) * n_bytes)


def lm_metrics(docs: DataFrame, by: list[str]) -> DataFrame:
    """Bits per byte and character, and token perplexity, from sums of documents."""
    out = docs.groupBy(*by).agg(F.sum("nll").alias("total_nll"), F.sum("bytes").alias("n_bytes"), F.sum("chars").alias("n_chars"), F.sum("tokens").alias("n_tokens"))
    return out.select("*", bits_per_byte(F.col("total_nll"), F.col("n_bytes")).alias("bpb"), bits_per_byte(F.col("total_nll"), F.col("n_chars")).alias("bpc"), F.exp(F.try_divide("total_nll", "n_tokens")).alias("token_ppl"))


def seed_spread(values: DataFrame, by: list[str], value: str, seeds: int = 3) -> DataFrame:
    """Sample deviation over the seeds, raw and of values rounded to four places; null unless all seeds are there."""
    whole = F.count(value) == seeds
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.when(whole, F.stddev_samp(value)).alias("sigma"), F.when(whole, F.stddev_samp(F.bround(value, 4))).alias("sigma_rounded"))


def describe(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, and the t interval of three values."""
    out = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") == 3, T_DF2 * F.col("sd") / F.sqrt(F.col("n")))
    return out.select("*", (F.col("mean") - half).alias("ci_lo"), (F.col("mean") + half).alias("ci_hi"))


def order_statistics(values: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``n`` and, by group, the values at ranks from 1; a rank is an expression of ``n``.

    Distinct values are counted and dealt by range. The sums of the ranges tell
    which one holds a rank, so no task holds a group's values.
    """
    counts = values.groupBy(*by, value).agg(F.count("*").alias("__c"))
    dealt = scratch.cut(counts.repartitionByRange(*by, value).withColumn("__p", F.spark_partition_id()))
    ranges = dealt.groupBy(*by, "__p").agg(F.sum("__c").alias("__s"))
    w = Window.partitionBy(*by)
    before = ranges.select(*by, "__p", (F.sum("__s").over(w.orderBy("__p")) - F.col("__s")).alias("__b"), F.sum("__s").over(w).alias("n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__p"]]
    rows = dealt.alias("a").join(before.alias("b"), functools.reduce(Column.__and__, same)).select("a.*", "__b", "n")
    upto = F.col("__b") + F.sum("__c").over(Window.partitionBy(*by, "__p").orderBy(value))
    return rows.withColumn("__u", upto).groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("__u") >= r, F.col(value))).alias(k) for k, r in ranks.items()))


def percentiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``n`` and, by group, percentiles interpolated between the two nearest ranks."""
    n = F.col("n")
    ranks = {}
    for k, q in shares.items():
        ranks |= {f"{k}__lo": F.floor(q * (n - 1)) + 1, f"{k}__hi": F.ceil(q * (n - 1)) + 1}
    rows = order_statistics(values, by, value, ranks)
    part = lambda q: q * (n - 1) - F.floor(q * (n - 1))
    return rows.select(*by, "n", *((F.col(f"{k}__lo") * (1 - part(q)) + F.col(f"{k}__hi") * part(q)).alias(k) for k, q in shares.items()))


def latency_stats(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, sample deviation (0 for one run), and the 95th percentile at the banker's-rounded rank."""
    base = runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    n = F.col("n")
    ranked = order_statistics(runs, by, value, {"lo": F.floor((n + 1) / 2), "hi": F.floor(n / 2) + 1, "p95": F.greatest(F.bround(0.95 * n), F.lit(1))})
    return ranked.join(base, by).select(*by, "n", "mean", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "std", "p95")


def quantile_digest(values: DataFrame, by: list[str], value: str, qs: list[int]) -> DataFrame:
    """Values at index min(n - 1, floor(q / 100 * n)) of the sorted values."""
    return order_statistics(values, by, value, {f"q{q}": F.least(F.col("n") - 1, F.floor(F.lit(q / 100.0) * F.col("n"))) + 1 for q in qs})


def accuracy(predictions: DataFrame, by: str) -> DataFrame:
    """Accuracy by subject and over all (a null subject)."""
    hit = (F.col("pred") == F.col("gold")).cast("int")
    return predictions.rollup(by).agg(F.count("*").alias("n_items"), F.sum(hit).alias("n_correct"), F.avg(hit).alias("accuracy"))


def tiers(docs: DataFrame, tier: Column) -> DataFrame:
    """Tokens per character by tier, and over all tiers."""
    out = docs.withColumn("tier", tier).rollup("tier").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))
    return out.withColumn("tok_per_char", F.try_divide("n_tokens", "n_chars"))


def contamination(items: DataFrame, docs: DataFrame, n: int = 13, least: int = 10, form=None) -> DataFrame:
    """Coverage of each item's distinct character n-grams by the documents, and its class.

    The items' distinct grams are the small side: they are broadcast while they
    are few, else Spark shuffles; documents are scanned once and never exploded
    beyond the grams that hit.
    """
    from ..functions import text as T

    form = form or T.contamination_form
    grams = items.select("item_id", F.explode(F.array_distinct(T.grams(form(F.col("text")), n))).alias("gram"))
    size = grams.select("gram").distinct()
    count = size.count()
    small = F.broadcast(size) if count <= 2_000_000 else size
    formed = docs.select(form(F.col("text")).alias("__t"))
    hits = formed.select(F.explode(F.array_distinct(T.grams(F.col("__t"), n))).alias("gram")).join(small, "gram", "left_semi").distinct()
    found = grams.join(hits.withColumn("hit", F.lit(1)), "gram", "left").groupBy("item_id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_hit"))
    rows = items.select("item_id").join(found, "item_id", "left").fillna(0, ["n_grams", "n_hit"])
    coverage = F.coalesce(F.try_divide("n_hit", "n_grams"), F.lit(0.0))
    kind = F.when(F.col("n_grams") < least, F.when(coverage >= 0.5, "short_high").otherwise("short")).when(coverage >= 0.5, "high").when(coverage >= 0.2, "middle").when(F.col("n_hit") > 0, "low").otherwise("none")
    return rows.select("item_id", "n_grams", "n_hit", coverage.alias("coverage"), kind.alias("kind"))


def bootstrap_accuracy(predictions: DataFrame, by: list[str], n: int = 10_000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of ``correct`` by group, from counts of the two outcomes.

    A resample's number of hits is binomial, so a group is one row of two counts
    and its size doesn't matter.
    """
    counts = predictions.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("hits"))
    keys = counts.select(*by).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lo, hi = [], []
            for r in b.itertuples():
                if not r.n:
                    lo.append(None)
                    hi.append(None)
                    continue
                m = np.random.default_rng(seed).binomial(r.n, r.hits / r.n, n) / r.n
                lo.append(float(np.percentile(m, 2.5)))
                hi.append(float(np.percentile(m, 97.5)))
            yield b.assign(value=b["hits"] / b["n"], ci_lo=lo, ci_hi=hi)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.fields)
    return counts.mapInPandas(run, f"{kind}, n bigint, hits bigint, value double, ci_lo double, ci_hi double".removeprefix(", "))


def paired_ratio_bootstrap(pairs: DataFrame, by: list[str], n: int = 10_000, seed: int = 0, block: int = 64) -> DataFrame:
    """Difference of two bits-per-byte over resampled documents: point, interval, standard error.

    ``pairs``: nll_a, bytes_a, nll_b, bytes_b, doc (an integer). In a resample a
    document counts as often as a Poisson draw of its own says, which only its
    number and the seed decide; the same draws are for both sides. Each task sums
    its documents by resample, so a group of any size is spread over tasks, and
    ``n`` sums of four numbers a task are what is shuffled.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*by).schema.fields)
    sides = ["nll_a", "bytes_a", "nll_b", "bytes_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(by, dropna=False) if by else [((), batch)]
            for key, g in groups:
                own = sums.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((n + 1, 5)))
                values = g[sides].to_numpy(float)
                own[n, :4] += values.sum(0)
                own[n, 4] += len(g)
                for at in range(0, len(g), block):
                    draws = np.stack([np.random.default_rng([seed, int(d) & (1 << 64) - 1]).poisson(1.0, n) for d in g["doc"].iloc[at : at + block]])
                    own[:n, :4] += draws.T.astype(float) @ values[at : at + block]
        for key, own in sums.items():
            rows = pd.DataFrame(own, columns=[*sides, "docs"])
            for name, value in zip(by, key, strict=True):
                rows[name] = value
            yield rows.assign(__k=np.arange(n + 1), docs=rows["docs"].astype("int64"))[[*by, "__k", *sides, "docs"]]

    drawn = pairs.select(*by, "doc", *sides).mapInPandas(run, f"{kind}, __k int, {', '.join(f'{s} double' for s in sides)}, docs bigint".removeprefix(", "))
    total = drawn.groupBy(*by, "__k").agg(*(F.sum(s).alias(s) for s in [*sides, "docs"]))
    diff = bits_per_byte(F.col("nll_b"), F.col("bytes_b")) - bits_per_byte(F.col("nll_a"), F.col("bytes_a"))
    rows = total.withColumn("__d", diff)
    point, resample = F.col("__k") == n, F.when(F.col("__k") < n, F.col("__d"))
    q = F.percentile(resample, F.array(F.lit(0.025), F.lit(0.975)))  # of n numbers
    out = rows.groupBy(*by).agg(F.max(F.when(point, F.col("docs"))).alias("n_docs"), F.max(F.when(point, F.col("__d"))).alias("diff"), q.alias("__q"), F.stddev_samp(resample).alias("se"))
    return out.select(*by, "n_docs", "diff", F.col("__q")[0].alias("ci_lo"), F.col("__q")[1].alias("ci_hi"), "se")


def strata_intervals(pairs: DataFrame, count: str = "n_removed", least: int = 30, n: int = 10_000, seed: int = 0) -> DataFrame:
    """Bits per byte of both sides and the interval of their difference by exposure stratum; null under ``least`` documents."""
    rows = exposure_strata(pairs, count)
    sums = rows.groupBy("stratum").agg(F.count("*").alias("n_docs"), F.min(count).alias("least_count"), F.max(count).alias("most_count"), bits_per_byte(F.sum("nll_a"), F.sum("bytes_a")).alias("bpb_a"), bits_per_byte(F.sum("nll_b"), F.sum("bytes_b")).alias("bpb_b"))
    found = paired_ratio_bootstrap(rows, ["stratum"], n, seed).drop("n_docs")
    enough = F.col("n_docs") >= least
    out = sums.join(found, "stratum")
    return out.select("stratum", "n_docs", "least_count", "most_count", *(F.when(enough, F.col(c)).alias(c) for c in ("bpb_a", "bpb_b", "diff", "ci_lo", "ci_hi")))


def exposure_strata(docs: DataFrame, count: str = "n_removed") -> DataFrame:
    """zero, low or high by the median of counts over zero."""
    middle = percentiles(docs.filter(F.col(count) > 0).select(count), [], count, {"__m": 0.5}).select("__m")
    return docs.crossJoin(F.broadcast(middle)).withColumn("stratum", F.when(F.col(count) == 0, "zero").when(F.col(count) <= F.col("__m"), "low").otherwise("high")).drop("__m")
