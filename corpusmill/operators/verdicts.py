"""Registered decision rules as CASE expressions. Missing evidence is null, never a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registered constants of the rules.
SIGMA_K, PREDICTION_K = 2.0, 4.9684
FLOOR, WARM, BAND, CHANCE, TOLERANCE, REPRODUCED = 0.005, 0.010, 0.02, 0.25, 0.001, 5e-7
RHO_LOW, RHO_HIGH = 0.25, 0.50


def sigma_rule(delta: Column, sigma_a: Column, sigma_b: Column) -> Column:
    """Struct of k, verdict, and whether k is beyond the prediction interval."""
    k = F.try_divide(F.abs(delta), F.greatest(sigma_a, sigma_b))
    verdict = F.when(k <= SIGMA_K, "indistinct").when(k.isNotNull(), F.when(delta > 0, "worse").otherwise("better"))
    return F.struct(k.alias("k"), verdict.alias("verdict"), (k > PREDICTION_K).alias("beyond"))


def floor_rule(delta: Column, sigma: Column) -> Column:
    """Three-way against the larger of two sigma and the floor; null without a delta."""
    bound = F.greatest(2 * sigma, F.lit(FLOOR))
    return F.when(delta.isNull() | sigma.isNull(), None).when(delta > bound, "worse").when(delta < -bound, "better").otherwise("indistinct")


def recovery(before: Column, after: Column, control: Column) -> Column:
    """(before - after) / (before - control); null where there was nothing to recover."""
    return F.when(before > control, (before - after) / (before - control))


def rho(first: Column, second: Column) -> Column:
    return F.when(first > 0, (first - second) / first)


def rho_class(value: Column) -> Column:
    return F.when(value <= RHO_LOW, "small").when(value <= RHO_HIGH, "middle").when(value.isNotNull(), "large")


def warm_gate(delta: Column) -> Column:
    return F.when(delta.isNull(), None).otherwise(delta >= WARM)


def confirmed(ci_low: Column) -> Column:
    return F.when(ci_low.isNull(), None).otherwise(ci_low > 0)


def equivalence(control_low: Column, diff_low: Column, diff_high: Column) -> Column:
    """Chance floor first, then the band, then the sign of the interval."""
    return (
        F.when(control_low <= CHANCE, "floor")
        .when((diff_low >= -BAND) & (diff_high <= BAND), "equivalent")
        .when(diff_high < 0, "worse")
        .when(diff_low > 0, "better")
        .when(diff_low.isNotNull(), "undecided")
    )


def saturated(ratio: Column) -> Column:
    return (ratio > 0.5) & (ratio <= 0.9)


def calibration_gate(trials: DataFrame, target: float = 2.058, band: float = 0.05, most: int = 30_000) -> DataFrame:
    """The K whose ratio is closest to the target, and whether it is inside the band."""
    return trials.filter(F.col("k") <= most).agg(F.min_by(F.struct("k", "ratio"), F.struct(F.abs(F.col("ratio") - target), F.col("k"))).alias("b")).select("b.k", "b.ratio", (F.abs(F.col("b.ratio") - target) <= band).alias("inside"))


def predecay_agrees(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Whether all shared checkpoints agree; null if one is missing."""
    missing = F.count_if(F.col(a).isNull() | F.col(b).isNull()) > 0
    return pairs.groupBy(*by).agg(F.when(~missing, F.bool_and(F.abs(F.col(a) - F.col(b)) <= TOLERANCE)).alias("agrees"))


def schedule_conforms(curve: DataFrame, by: list[str], lr: str, expected: Column, decayed: Column) -> DataFrame:
    """Whether logged rates follow a schedule and at least one of them is decayed."""
    near = F.abs(F.col(lr) - expected) <= 1e-3 * F.abs(expected)
    return curve.groupBy(*by).agg((F.bool_and(near) & F.bool_or(decayed)).alias("conforms"))


def reproduced(doc_sum: Column, recorded: Column) -> Column:
    return F.when(doc_sum.isNull() | recorded.isNull(), None).otherwise(F.abs(F.bround(doc_sum, 6) - recorded) < REPRODUCED)


def reproduction_status(ko: Column, en: Column) -> Column:
    return F.when(ko & en, "reproduced").when((ko == F.lit(False)) | (en == F.lit(False)), "differs").otherwise("unrecorded")


def seed_pairs(metrics: DataFrame, treat: str, control: str, value: str = "bpb") -> DataFrame:
    """Treatment joined with control by seed and domain, with the difference."""
    side = lambda arm, name: metrics.filter(F.col("arm") == arm).select("seed", "domain", F.col(value).alias(name))
    return side(treat, "treat").join(side(control, "control"), ["seed", "domain"]).withColumn("diff", F.col("treat") - F.col("control"))


def pair_integrity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: null if both lists have the same documents and raw bytes, else what differs first."""
    both = a.select("doc", F.col("raw_bytes").alias("x")).join(b.select("doc", F.col("raw_bytes").alias("y")), "doc", "full_outer")
    wrong = both.filter(~F.col("x").eqNullSafe(F.col("y")))
    return wrong.agg(F.min_by(F.concat(F.lit("document "), F.col("doc"), F.when(F.col("x").isNull() | F.col("y").isNull(), ": only on one side").otherwise(": raw bytes differ")), "doc").alias("problem"))
