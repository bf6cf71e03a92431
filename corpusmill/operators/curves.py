"""Curves over an ordered axis: as-of and range lookups, grids, integrals, slopes, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, x: str, value: str, tolerance: float) -> DataFrame:
    """For each row of ``left`` the value of the nearest x of ``right`` within the tolerance, the lower one at a tie; null without.

    Rows meet in buckets one tolerance wide, so each meets at most three buckets
    of its key: no range join.
    """
    bucket = F.floor(F.col(x) / tolerance)
    asked = left.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    known = right.select(F.col(key).alias("__k"), F.col(x).alias("__x"), F.col(value).alias("__v"), bucket.alias("__b"))
    gap = F.abs(F.col(x) - F.col("__x"))
    found = asked.join(known, (F.col(key) == F.col("__k")) & (asked["__b"] == known["__b"]) & (gap <= tolerance), "inner")
    best = found.groupBy(key, x).agg(F.min_by(F.struct(F.col("__x").alias("x"), F.col("__v").alias("v")), F.struct(gap, F.col("__x"))).alias("n"))
    return left.join(best, [key, x], "left").select(*left.columns, F.col("n.x").alias(f"{x}_near"), F.col("n.v").alias(value))


def value_at(curve: DataFrame, key: str, x: str, value: str, at: float, slack: float) -> DataFrame:
    """By key the value in [at, at + slack): null unless exactly one row is there."""
    inside = (F.col(x) >= at) & (F.col(x) < at + slack)
    return curve.groupBy(key).agg(F.when(F.count_if(inside) == 1, F.max(F.when(inside, F.col(value)))).alias(value))


def grid_snap(curve: DataFrame, key: str, x: str, value: str, step: float, within: float) -> DataFrame:
    """The last value near each multiple of ``step``."""
    point = F.bround(F.col(x) / step) * step
    rows = curve.withColumn("grid", point).filter(F.abs(F.col(x) - F.col("grid")) <= within)
    return rows.groupBy(key, "grid").agg(F.max_by(value, x).alias(value))


def interpolate(curve: DataFrame, points: DataFrame, key: str, x: str, value: str, at: str) -> DataFrame:
    """Linear interpolation of each key's curve at the points (key, at); ends are held.

    Points and knots are sorted together by key; the knots before and after are
    the last ones in that order and in the reverse one, so no range join is
    needed and a key's rows are passed over twice.
    """
    knots = curve.groupBy(key, F.col(x).cast("double").alias("__x")).agg(F.max(value).cast("double").alias("__v"))
    both = knots.select(key, "__x", "__v", F.lit(None).cast("double").alias(at)).unionByName(points.select(key, F.col(at).cast("double").alias("__x"), F.lit(None).cast("double").alias("__v"), F.col(at).cast("double").alias(at)))
    up = Window.partitionBy(key).orderBy("__x", F.col("__v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("__x"), F.col("__v").isNull().desc()).rowsBetween(Window.unboundedPreceding, 0)
    knot = F.when(F.col("__v").isNotNull(), F.struct("__x", "__v"))
    rows = both.withColumn("lo", F.last(knot, True).over(up)).withColumn("hi", F.last(knot, True).over(down)).filter(F.col(at).isNotNull())
    t = (F.col(at) - F.col("lo.__x")) / F.nullif(F.col("hi.__x") - F.col("lo.__x"), F.lit(0.0))
    out = F.when(F.col("lo").isNull(), F.col("hi.__v")).when(F.col("hi").isNull(), F.col("lo.__v")).otherwise(F.coalesce(F.col("lo.__v") + t * (F.col("hi.__v") - F.col("lo.__v")), F.col("lo.__v")))
    return rows.select(key, at, out.alias(value))


def trapezoid(curve: DataFrame, key: str, x: str, value: str) -> DataFrame:
    """Cumulative integral of each key's curve."""
    w = Window.partitionBy(key).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2.0
    return curve.withColumn("__p", F.coalesce(part, F.lit(0.0))).withColumn("integral", F.sum("__p").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__p")


def slopes(curve: DataFrame, key: str, x: str, value: str) -> DataFrame:
    """Slope from the row before, and the rate of the logarithm."""
    w = Window.partitionBy(key).orderBy(x)
    dx = F.nullif(F.col(x) - F.lag(x).over(w), F.lit(0))
    ratio = F.try_divide(F.col(value), F.lag(value).over(w))
    return curve.withColumn("slope", (F.col(value) - F.lag(value).over(w)) / dx).withColumn("log_rate", F.when(ratio > 0, F.ln(ratio)) / dx)


def crossings(curve: DataFrame, key: str, x: str, every: float, extra: list[float] = ()) -> DataFrame:
    """The first row at or after each multiple of ``every``, and after each extra point."""
    w = Window.partitionBy(key).orderBy(x)
    step = F.floor(F.col(x) / every)
    due = step > F.coalesce(F.lag(step).over(w), F.lit(0))
    for p in extra:
        due = due | ((F.col(x) >= p) & (F.coalesce(F.lag(x).over(w), F.lit(float("-inf"))) < p))
    return curve.withColumn("__due", due).filter("__due").drop("__due")


def doublings(curve: DataFrame, key: str, x: str, value: str, start: float) -> DataFrame:
    """Gain of each doubling of x from ``start``, and its ratio to the gain before."""
    w = Window.partitionBy(key).orderBy(x)
    power = F.log2(F.col(x) / start)
    rows = curve.filter((F.col(x) >= start) & (power == F.round(power)))
    gain = F.col(value) - F.lag(value).over(w)
    return rows.withColumn("gain", gain).withColumn("gain_ratio", F.try_divide(F.col("gain"), F.lag("gain").over(w)))


def loglog_fit(curve: DataFrame, key: str, x: str, value: str, floors: list[float]) -> DataFrame:
    """Least squares of ln(value - floor) on ln(x) by floor: slope and squared error; floors at or over the least value are passed over."""
    least = curve.groupBy(key).agg(F.min(value).alias("__least"))
    rows = curve.filter(F.col(x) > 0).join(least, key).withColumn("floor", F.explode(F.array(*map(F.lit, floors)))).filter(F.col("floor") < F.col("__least"))
    lx, ly = F.ln(F.col(x)), F.ln(F.col(value) - F.col("floor"))
    sse = F.regr_syy(ly, lx) - F.try_divide(F.pow(F.regr_sxy(ly, lx), F.lit(2.0)), F.regr_sxx(ly, lx))
    return rows.groupBy(key, "floor").agg(F.count("*").alias("n"), F.regr_slope(ly, lx).alias("slope"), sse.alias("sse"))


def half_life(first: Column, second: Column, dx: Column) -> Column:
    """Half-life of an exponential decay between two gaps; null unless it decays."""
    rate = F.when((first > 0) & (second > 0) & (second < first), F.ln(first / second) / dx)
    return F.ln(F.lit(2.0)) / rate


def cosine_lr(x: Column, total: float, base: float, warm: float, least: float = 0.0) -> Column:
    """Linear warm-up to ``base``, then a half cosine to ``least`` of it."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - warm) / max(1.0, total - warm)))
    return base * F.when(x < warm, x / max(1.0, warm)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * t)))


def constant_lr(x: Column, base: float, warm: float) -> Column:
    return base * F.when(x < warm, x / max(1.0, warm)).otherwise(F.lit(1.0))


def wsd_lr(x: Column, total: float, base: float, warm: float, decay: float, least: float = 0.0) -> Column:
    """Warm-up, a constant part, and a linear decay over the last share ``decay``."""
    start = total * (1 - decay)
    fall = F.greatest(F.lit(least), 1 - (1 - least) * (x - start) / max(1.0, total - start))
    return base * F.when(x < warm, x / max(1.0, warm)).when(x < start, F.lit(1.0)).otherwise(fall)
