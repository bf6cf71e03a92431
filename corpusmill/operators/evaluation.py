"""Prompts, subsets, claims and checks around evaluation tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import stats
from .budget import global_rank


def format_item(question: Column, choices: list[Column], answer: Column | None = None) -> Column:
    """A multiple-choice item with lettered choices; open-ended without an answer (0 to 3)."""
    lettered = [F.concat(F.lit(f"{letter}. "), c) for letter, c in zip("ABCD", choices, strict=True)]
    end = F.lit("정답:") if answer is None else F.concat(F.lit("정답: "), F.element_at(F.array(*map(F.lit, "ABCD")), answer + 1))
    return F.concat_ws("\n", question, *lettered, end)


def few_shot(target: Column, shots: Column, count: Callable[[Column], Column], most: int = 2048) -> Column:
    """Struct of the prompt and its number of shots: the earliest shots go until it fits; the target never does.

    ``shots``: array of formatted items, earliest first. ``count``: tokens of a text.
    """
    n = F.size(shots)
    kept = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((n - k).alias("n_shot"), F.concat_ws("\n\n", F.slice(shots, k + 1, F.greatest(n - k, F.lit(0))), target).alias("prompt")))
    fits = F.filter(kept, lambda x: (count(x["prompt"]) <= most) | (x["n_shot"] == 0))
    return F.element_at(fits, 1)


def argmax_first(values: Column) -> Column:
    """Place of the greatest value; the first at a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def local_time(ts_utc: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.to_timestamp(ts_utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), zone), "yyyy-MM-dd HH:mm:ss")


def dense_subset(docs: DataFrame, pattern: str = T.HAN_BENCH, least: int = 20, share: float = 0.005, expect: int | None = None) -> DataFrame:
    """Documents with enough characters of a class; a count that isn't the expected one raises."""
    n = F.regexp_count("text", F.lit(pattern))
    out = docs.withColumn("n_class", n).filter((F.col("n_class") >= least) & (F.col("n_class") >= share * F.length("text")))
    if expect is not None and (got := out.count()) != expect:
        raise ValueError(f"{got} documents instead of {expect}")
    return out


def damaged_rows(stats: DataFrame, parents: DataFrame, count: str, least: int, most: int, k: int) -> DataFrame:
    """The k most frequent unprotected tokens with parents and a count in the range; fewer raise."""
    rows = stats.filter(~F.col("is_protected") & F.col(count).between(least, most)).join(parents.select("token"), "token", "left_semi").orderBy(F.desc(count), "token_id").limit(k)
    if rows.count() < k:
        raise ValueError(f"fewer than {k} rows to damage")
    return rows


def latest_ok(ledger: DataFrame, key: str = "run_id", order: str = "pos") -> DataFrame:
    """The last successful row of each run."""
    return ledger.filter("status = 'ok'").groupBy(key).agg(F.max_by(F.struct(*[c for c in ledger.columns if c != key]), order).alias("r")).select(key, "r.*")


def last_rows(ledger: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return ledger.orderBy(F.desc(order)).limit(n)


def evaluated_compression(docs: DataFrame, evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Bytes per token on exactly the evaluated documents; a byte count that differs raises when rows are read."""
    both = evaluated.select("doc", F.col("raw_bytes").alias("__b"), "tokens").join(docs.withColumn("__n", F.octet_length("text")), "doc")
    checked = F.when(F.col("__b") == F.col("__n"), F.col("__n")).otherwise(F.raise_error(F.concat(F.lit("bytes differ for document "), F.col("doc").cast("string"))))
    return both.withColumn("__c", checked).groupBy(*by).agg(F.sum("__c").alias("n_bytes"), F.sum("tokens").alias("n_tokens"), F.try_divide(F.sum("__c"), F.sum("tokens")).alias("bytes_per_tok"))


def recomputed(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Bits per byte from the stored sums where a key has exactly one row; null otherwise."""
    return metrics.groupBy(*by).agg(F.when(F.count("*") == 1, F.max(F.try_divide("total_nll", F.ln(F.lit(2.0)) * F.col("n_bytes")))).alias("bpb"))


def pool_order(pool: DataFrame, first: int, id_: str = "ord", seed: int = 0) -> DataFrame:
    """A seeded order of a pool; what was added after the first rows comes after them in an order of its own, so the prefix stays."""
    late = (F.col(id_) >= first).cast("int")
    key = F.xxhash64(F.col(id_), F.lit(seed) + late)
    return global_rank(pool, [late, key, F.col(id_)], "pool_rank")


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether two lists have the same keys, and how many each has alone."""
    both = a.select(key).distinct().withColumn("x", F.lit(1)).join(b.select(key).distinct().withColumn("y", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b")).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def paired_difference(predictions: DataFrame, by: list[str], n: int = 10_000, seed: int = 0) -> DataFrame:
    """Interval of the difference of two accuracies on the same items, from the counts of the four outcomes.

    Resampled items are multinomial over the outcomes, so a group is one row.
    """
    import numpy as np

    a, b = F.col("correct_a"), F.col("correct_b")
    counts = predictions.groupBy(*by).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*by).schema.fields)

    def run(batches):
        for g in batches:
            lo, hi, point = [], [], []
            for r in g.itertuples():
                total = r.n11 + r.n10 + r.n01 + r.n00
                if not total:
                    lo.append(None)
                    hi.append(None)
                    point.append(None)
                    continue
                draws = np.random.default_rng(seed).multinomial(total, np.array([r.n11, r.n10, r.n01, r.n00]) / total, n)
                d = (draws[:, 2] - draws[:, 1]) / total
                lo.append(float(np.percentile(d, 2.5)))
                hi.append(float(np.percentile(d, 97.5)))
                point.append((r.n01 - r.n10) / total)
            yield g[by].assign(diff=point, ci_lo=lo, ci_hi=hi)

    return counts.mapInPandas(run, f"{kind}, diff double, ci_lo double, ci_hi double".removeprefix(", "))


def retokenize_check(donors: DataFrame, encode) -> DataFrame:
    """Donors whose text is tokenised as exactly their two parts, those that aren't, and those without a text. ``encode``: Arrow UDF of ids."""
    rows = donors.withColumn("surface", T.byte_surface(True)(F.col("new_token")))
    told = rows.filter("surface is not null").withColumn("ids", encode(F.col("surface")))
    ok = F.col("ids") == F.array(F.col("left_id").cast("int"), F.col("right_id").cast("int"))
    return told.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_other")).crossJoin(F.broadcast(rows.agg(F.count_if(F.col("surface").isNull()).alias("n_undecodable"))))


def roundtrip_failures(texts: DataFrame, roundtrip) -> DataFrame:
    """Texts that a tokenizer doesn't give back. ``roundtrip``: Arrow UDF."""
    return texts.filter(~F.col("text").eqNullSafe(roundtrip(F.col("text"))))


def fertility(docs: DataFrame, by: list[str], analyze=None) -> DataFrame:
    """Tokens per analysed unit; without an analyzer, units are words between blanks."""
    units = T.count_words(F.col("text")) if analyze is None else analyze(F.col("text"))
    return docs.withColumn("__u", units).groupBy(*by).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("__u").alias("n_units"), F.try_divide(F.sum("n_tokens"), F.sum("__u")).alias("fertility"))


def claims(values: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row a claim over a one-row table of evidence: holds, doesn't, or can't be told (null)."""
    rows = F.array(*(F.struct(F.lit(n).alias("claim"), c.alias("holds")) for n, c in rules))
    return values.select(F.explode(rows).alias("c")).select("c.claim", "c.holds")


def null_models(curve: DataFrame, key: str, x: str, value: str) -> DataFrame:
    """What an exponential decay through the first three points predicts for the last, beside what was observed.

    Curves of fewer than four points have no row. Of points with equal x the greatest value counts.
    """
    points = curve.groupBy(key, F.col(x).cast("double").alias("__x")).agg(F.max(F.col(value).cast("double")).alias("__v"))
    ranks = stats.order_statistics(points.select(key, "__x"), [key], "__x", {"x0": F.lit(1), "x1": F.lit(2), "x2": F.lit(3), "x3": F.col("n")}).filter("n >= 4")
    at = lambda c: F.max(F.when(F.col("__x") == F.col(c), F.col("__v")))
    names = ["x0", "x1", "x2", "x3"]
    rows = points.join(ranks, key).filter(F.col("__x").isin(*map(F.col, names))).groupBy(key, *names).agg(*(at(c).alias(f"v{c[1]}") for c in names))
    v0, v1, v2, v3, x1, x2, x3 = (F.col(c) for c in ("v0", "v1", "v2", "v3", "x1", "x2", "x3"))
    d1, d2 = v0 - v1, v1 - v2
    ratio = F.when((d1 > 0) & (d2 > 0) & (d2 < d1), d2 / d1)
    steps = (x3 - x2) / (x2 - x1)
    predicted = v2 - d2 * ratio * (1 - F.pow(ratio, steps)) / (1 - ratio)
    return rows.select(key, x3.alias(x), predicted.alias("predicted"), v3.alias("observed"), (v3 - predicted).alias("excess"))


def tokenizer(load: Callable):
    """Arrow UDF: number of tokens, by a tokenizer that ``load()`` gives once a batch."""

    @F.pandas_udf("bigint")
    def f(s: pd.Series) -> pd.Series:
        t = load()
        return s.map(lambda x: len(t.encode(x or "", add_special_tokens=False).ids))

    return f
