"""Time-domain features of one signal per group, split into families that share a pass.

Every family is ``f(df, keys, order, value) -> one row per key``; ``order[0]`` is the clock.
Definitions follow the public feature-extraction literature; 0-based positions.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracework.functions.numeric import adjusted_kurtosis, adjusted_skew, correlation
from tracework.operators.ordered import group_quantiles, ordered_columns, range_count
from tracework.operators.quality import with_group_stats

# Benford's law probabilities come from this rule for the digits 1..9.
DIGITS = range(1, 10)


def moments(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """All features that are plain aggregates."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.sum(v * v).alias("abs_energy"), F.max(F.abs(v)).alias("absolute_maximum"), F.count(v).alias("length"),
        F.max(v).alias("maximum"), F.min(v).alias("minimum"), F.avg(v).alias("mean"), F.sum(v).alias("sum_values"),
        F.sqrt(F.avg(v * v)).alias("root_mean_square"), F.stddev_pop(v).alias("standard_deviation"),
        F.var_pop(v).alias("variance"), F.skewness(v).alias("_s"), F.kurtosis(v).alias("_k"))
    return g.select(
        *keys, "abs_energy", "absolute_maximum", "length", "maximum", "minimum", "mean", "sum_values",
        "root_mean_square", "standard_deviation", "variance",
        adjusted_skew(F.col("length"), F.col("_s")).alias("skewness"),
        adjusted_kurtosis(F.col("length"), F.col("_k")).alias("kurtosis"),
        (F.col("variance") > F.col("standard_deviation")).alias("variance_larger_than_standard_deviation"),
        F.when(F.col("mean") != 0, F.col("standard_deviation") / F.col("mean")).alias("variation_coefficient"))


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Features of successive differences."""
    d = ordered_columns(df, keys, order, lag={"_p": value}, index="_i", total={"_n": ("count", F.lit(1))})
    v, step, i, n = F.col(value), F.abs(F.col(value) - F.col("_p")), F.col("_i"), F.col("_n")
    at = lambda pos: F.max(F.when(i == pos, v))
    g = d.groupBy(*keys).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("absolute_sum_of_changes"), F.avg(step).alias("mean_abs_change"),
        at(0).alias("_0"), at(1).alias("_1"), at(n - 2).alias("_y"), at(n - 1).alias("_z"), F.max(n).alias("_n"))
    return g.select(
        *keys, "absolute_sum_of_changes", "mean_abs_change",
        F.when(F.col("_n") > 1, (F.col("_z") - F.col("_0")) / (F.col("_n") - 1)).alias("mean_change"),
        F.when(F.col("_n") > 2, (F.col("_z") - F.col("_y") - F.col("_1") + F.col("_0")) / (2 * (F.col("_n") - 2))
               ).alias("mean_second_derivative_central"))


def locations(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Relative first and last positions of the extremes."""
    d = ordered_columns(df, keys, order, index="_i")
    i, v, n = F.col("_i"), F.col(value), F.count(F.lit(1))
    return d.groupBy(*keys).agg(
        (F.max_by(i, F.struct(v, -i)) / n).alias("first_location_of_maximum"),
        (F.min_by(i, F.struct(v, i)) / n).alias("first_location_of_minimum"),
        ((F.max_by(i, F.struct(v, i)) + 1) / n).alias("last_location_of_maximum"),
        ((F.min_by(i, F.struct(v, -i)) + 1) / n).alias("last_location_of_minimum"))


def mean_crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Strict counts on both sides of the mean."""
    d = with_group_stats(df, keys, F.avg(value).alias("_m"))
    return d.groupBy(*keys).agg(F.count_if(F.col(value) > F.col("_m")).alias("count_above_mean"),
                                F.count_if(F.col(value) < F.col("_m")).alias("count_below_mean"))


def strikes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Longest runs strictly above and strictly below the mean."""
    d = with_group_stats(df, keys, F.avg(value).alias("_m"))
    d = d.withColumn("_side", F.signum(F.col(value) - F.col("_m")))
    ranges = range_count(df)
    d = ordered_columns(d, keys, order, ranges=ranges, lag={"_ps": "_side"})
    d = d.withColumn("_new", F.when(F.col("_ps") == F.col("_side"), 0).otherwise(1)).drop("_ps")
    d = ordered_columns(d, keys, order, ranges=ranges, running={"_run": "_new"})
    r = d.groupBy(*keys, "_run", "_side").agg(F.count(F.lit(1)).alias("_len"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_side") == s, F.col("_len"))), F.lit(0))
    return r.groupBy(*keys).agg(longest(1).alias("longest_strike_above_mean"), longest(-1).alias("longest_strike_below_mean"))


def value_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Features of repeated values; values are counted per key first."""
    v, c = F.col(value), F.col("_c")
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    rep = c > 1
    return counts.groupBy(*keys).agg(
        (F.count_if(rep) > 0).alias("has_duplicate"),
        (F.max_by(c, v) > 1).alias("has_duplicate_max"), (F.min_by(c, v) > 1).alias("has_duplicate_min"),
        (F.coalesce(F.sum(F.when(rep, c)), F.lit(0)) / F.sum(c)).alias("percentage_of_reoccurring_datapoints_to_all_datapoints"),
        (F.count_if(rep) / F.count(F.lit(1))).alias("percentage_of_reoccurring_values_to_all_values"),
        (F.count(F.lit(1)) / F.sum(c)).alias("ratio_value_number_to_time_series_length"),
        F.coalesce(F.sum(F.when(rep, v * c)), F.lit(0.0)).alias("sum_of_reoccurring_data_points"),
        F.coalesce(F.sum(F.when(rep, v)), F.lit(0.0)).alias("sum_of_reoccurring_values"))


def median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return group_quantiles(df, keys, value, {"median": 0.5})


def benford(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Correlation of first-digit shares with log10(1 + 1/d); null when undefined."""
    a = F.abs(F.col(value))
    power = F.floor(F.log10(a))
    lead = F.when(power < -300, a * F.lit(1e300) / F.pow(F.lit(10.0), power + 300)).otherwise(a / F.pow(F.lit(10.0), F.greatest(power, F.lit(-300))))
    digit = F.floor(lead + F.lit(1e-9)).cast("int")
    per = df.where(a > 0).groupBy(*keys).agg(*[F.count_if(digit == d).alias(f"_d{d}") for d in DIGITS], F.count(F.lit(1)).alias("_n"))
    pairs = F.explode(F.array(*[
        F.struct((F.col(f"_d{d}") / F.col("_n")).alias("share"), F.lit(float(np.log10(1 + 1 / d))).alias("law")) for d in DIGITS]))
    long = per.select(*keys, pairs.alias("p"))
    r = F.when(F.stddev_pop("p.share") > 0, correlation("p.share", "p.law"))
    return long.groupBy(*keys).agg(r.alias("benford_correlation"))


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    from math import lgamma

    lg = np.vectorize(lgamma, otypes=[float])
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail probability of Student's t."""
    ok = t.notna() & dof.notna() & (dof > 0)
    out = pd.Series(np.nan, index=t.index, dtype=float)
    if ok.any():
        tv, nu = t[ok].to_numpy(float), dof[ok].to_numpy(float)
        out[ok] = _betainc(nu / 2, np.full_like(nu, 0.5), nu / (nu + tv * tv))
    return out


def linear_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, pvalue: bool = False) -> DataFrame:
    """Regression of the value on its position."""
    d = ordered_columns(df, keys, order, index="_i").withColumn("_x", F.col("_i").cast("double"))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(value, "_x").alias("linear_trend_slope"),
        F.regr_intercept(value, "_x").alias("linear_trend_intercept"),
        F.when(F.stddev_pop(value) > 0, correlation(value, "_x")).otherwise(F.lit(0.0)).alias("_r"),
        F.var_pop(value).alias("_vy"), F.var_pop("_x").alias("_vx"))
    r = F.when(F.col("_n") > 1, F.col("_r"))
    err = F.when((F.col("_n") > 2), F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * F.col("_vy") / F.col("_vx") / (F.col("_n") - 2))
                 ).when(F.col("_n") == 2, F.lit(0.0))
    out = g.withColumn("linear_trend_rvalue", r).withColumn("linear_trend_stderr", err)
    if pvalue:
        dof = (F.col("_n") - 2).cast("double")
        t = F.when((F.col("_n") > 2) & (1 - r * r > 0), r * F.sqrt(dof / F.when(1 - r * r > 0, 1 - r * r)))
        out = out.withColumn("linear_trend_pvalue", t_two_sided(t, dof))
    return out.drop("_n", "_r", "_vy", "_vx")


FAMILIES = {
    moments: ("abs_energy", "absolute_maximum", "length", "maximum", "minimum", "mean", "sum_values", "root_mean_square",
              "standard_deviation", "variance", "skewness", "kurtosis", "variance_larger_than_standard_deviation",
              "variation_coefficient"),
    changes: ("absolute_sum_of_changes", "mean_abs_change", "mean_change", "mean_second_derivative_central"),
    locations: ("first_location_of_maximum", "first_location_of_minimum", "last_location_of_maximum", "last_location_of_minimum"),
    mean_crossings: ("count_above_mean", "count_below_mean"),
    strikes: ("longest_strike_above_mean", "longest_strike_below_mean"),
    value_counts: ("has_duplicate", "has_duplicate_max", "has_duplicate_min",
                   "percentage_of_reoccurring_datapoints_to_all_datapoints", "percentage_of_reoccurring_values_to_all_values",
                   "ratio_value_number_to_time_series_length", "sum_of_reoccurring_data_points", "sum_of_reoccurring_values"),
    median: ("median",),
    benford: ("benford_correlation",),
    linear_trend: ("linear_trend_slope", "linear_trend_intercept", "linear_trend_rvalue", "linear_trend_stderr"),
}


def time_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Every time-domain family joined on the key (all sides share its partitioning)."""
    out = None
    for family in FAMILIES:
        part = family(df, keys, order, value, pvalue=True) if family is linear_trend else family(df, keys, order, value)
        out = part if out is None else out.join(part, list(keys), "left")
    return out
