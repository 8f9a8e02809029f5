"""Frequency-domain features from a half spectrum with columns k, f, m per key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.operators.ordered import ordered_columns, range_count
from tracework.operators.quality import with_group_stats

ROLLOFF, SIGNIFICANT = 0.85, 0.95


def simple(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features that need one aggregation over the bins."""
    m, f, k = F.col("m"), F.col("f"), F.col("k")
    e = m * m
    n = F.count(F.lit(1))
    top = F.max_by(f, F.struct(m, -k))
    return df.groupBy(*keys).agg(
        top.alias("fundamental_frequency"), top.alias("peak_frequency"), (F.sum(e) / n).alias("spectral_energy"),
        _ratio(F.sum(F.abs(f) * e), F.sum(e)).alias("spectral_centroid"),
        _ratio(F.exp(F.avg(F.when(m > 0, F.ln(m)))), F.avg(m)).alias("spectral_flatness"),
        F.skewness(m).alias("spectral_skewness"), F.kurtosis(m).alias("spectral_kurtosis"),
        _ratio(F.sum(f * m), F.sum(m)).alias("weighted_mean_frequency"),
        F.when(F.avg(m) != 0, F.stddev_pop(m) / F.avg(m)).otherwise(0.0).alias("coeff_variation"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def entropy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shannon entropy of the energy shares; empty bins add nothing."""
    e = F.col("m") * F.col("m")
    total = F.sum(e)
    # -sum p ln p = ln T - sum e ln e / T
    plogp = F.sum(F.when(e > 0, e * F.ln(e)).otherwise(0.0))
    return df.groupBy(*keys).agg(F.when(total > 0, F.ln(total) - plogp / total).alias("spectral_entropy"))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Energy-weighted deviation around the centroid."""
    e = F.col("m") * F.col("m")
    d = with_group_stats(df, keys, _ratio(F.sum(F.abs(F.col("f")) * e), F.sum(e)).alias("_c"))
    dev = (F.col("f") - F.col("_c")) * (F.col("f") - F.col("_c"))
    return d.groupBy(*keys).agg(F.sqrt(_ratio(F.sum(dev * e), F.sum(e))).alias("spectral_spread"))


def rolloff(df: DataFrame, keys: Sequence[str], share: float = ROLLOFF) -> DataFrame:
    """First frequency whose cumulative energy reaches the share of the total."""
    d = df.withColumn("_e", F.col("m") * F.col("m"))
    d = ordered_columns(d, keys, ["k"], running={"_cum": "_e"}, total={"_t": ("sum", F.col("_e"))})
    hit = F.col("_cum") >= F.lit(share) * F.col("_t")
    return d.groupBy(*keys).agg(F.min_by("f", F.when(hit, F.col("k"))).alias("rolloff_85"))


def local_maxima(df: DataFrame, keys: Sequence[str], index: str, value: str,
                 ranges: int | None = None) -> DataFrame:
    """Local maxima incl. flat tops (left-middle point); first and last point never count."""
    ranges = range_count(df) if ranges is None else ranges
    d = ordered_columns(df.select(*keys, index, value), keys, [index], ranges=ranges, lag={"_p": value})
    d = d.withColumn("_new", F.when(F.col("_p") == F.col(value), 0).otherwise(1)).drop("_p")
    d = ordered_columns(d, keys, [index], ranges=ranges, running={"_plateau": "_new"})
    flat = d.groupBy(*keys, "_plateau").agg(
        F.min(index).alias("_a"), F.max(index).alias("_b"), F.first(value).alias(value))
    flat = ordered_columns(flat, keys, ["_a"], ranges=ranges, lag={"_l": value}, lead={"_r": value})
    top = (F.col("_l") < F.col(value)) & (F.col("_r") < F.col(value))
    return flat.where(top).select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias(index), value)


def _spread4(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"),
            F.max(c).alias(f"max_{name}"), F.min(c).alias(f"min_{name}")]


def _zero_gaps(names: Sequence[str]) -> dict[str, Column]:
    return {n: F.coalesce(n, F.lit(0.0)) for n in names}


DIST = ("mean_peak_distance", "std_peak_distance", "max_peak_distance", "min_peak_distance")


def peaks(df: DataFrame, keys: Sequence[str], share: float = SIGNIFICANT) -> DataFrame:
    """22 features of the spectral peaks; null statistics where a series has no peak."""
    keys = list(keys)
    e = F.col("m") * F.col("m")
    total = df.groupBy(*keys).agg(F.sum(e).alias("_t"))
    ranges = range_count(df)
    tops = local_maxima(df, keys, "k", "m", ranges).join(df.select(*keys, "k", "f"), [*keys, "k"]).join(total, keys)
    tops = ordered_columns(tops, keys, ["k"], ranges=ranges, lag={"_pf": "f"}).withColumn("_ne", -e)
    tops = ordered_columns(tops, keys, ["_ne", "k"], ranges=ranges, running={"_cum": "_ne"})
    significant = F.count_if(-F.col("_cum") <= F.lit(share) * F.col("_t"))
    g = tops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_peaks"), *_spread4(F.col("m"), "peak_height"), *_spread4(F.col("f"), "peak_frequency"),
        *_spread4(e, "peak_energy"), *_spread4(e / F.col("_t"), "peak_energy_ratio"),
        significant.alias("num_significant_peaks"), *_spread4(F.col("f") - F.col("_pf"), "peak_distance"))
    out = total.drop("_t").join(g, keys, "left").na.fill(0, ["num_peaks", "num_significant_peaks"])
    return out.withColumns(_zero_gaps(DIST))


def psd(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """20 features of the power density m^2 / bins."""
    keys = list(keys)
    d = with_group_stats(df, keys, F.count(F.lit(1)).alias("_n")).withColumn("p", F.col("m") * F.col("m") / F.col("_n"))
    p = F.col("p")
    base = d.groupBy(*keys).agg(
        F.avg(p).alias("mean_psd"), F.stddev_pop(p).alias("std_psd"), F.max(p).alias("max_psd"), F.min(p).alias("min_psd"),
        F.skewness(p).alias("skewness_psd"), F.kurtosis(p).alias("kurtosis_psd"),
        _ratio(F.sum(F.col("f") * p), F.sum(p)).alias("power_centroid_psd"))
    ranges = range_count(df)
    tops = local_maxima(d, keys, "k", "p", ranges).join(df.select(*keys, "k", "f"), [*keys, "k"])
    tops = ordered_columns(tops, keys, ["k"], ranges=ranges, lag={"_pf": "f"})
    g = tops.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_peaks"), *_spread4(p, "peak_value"),
                                *_spread4(F.col("f"), "peak_frequency"), *_spread4(F.col("f") - F.col("_pf"), "peak_distance"))
    out = base.join(g, keys, "left").na.fill(0, ["num_peaks"])
    return out.withColumns(_zero_gaps(DIST))


def magnitude_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, std, the three largest and the smallest magnitude."""
    from tracework.operators.windows import top_k

    base = df.groupBy(*keys).agg(F.avg("m").alias("magnitude_mean"), F.stddev_pop("m").alias("magnitude_std"),
                                 F.min("m").alias("magnitude_min"))
    best = top_k(df, "m", 3, "k", keys).groupBy(*keys).agg(*[
        F.max(F.when(F.col("rank") == r, F.col("m"))).alias(f"magnitude_{r}_max") for r in (1, 2, 3)])
    return base.join(best, list(keys))


def bin_moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centroid, variance, skew and kurtosis of the bin number weighted by magnitude."""
    k, w = F.col("k").cast("double"), F.col("m")
    mom = lambda p: _ratio(F.sum(F.pow(k, F.lit(float(p))) * w), F.sum(w))
    g = df.groupBy(*keys).agg(*[mom(p).alias(f"_{p}") for p in (1, 2, 3, 4)])
    m1, m2, m3, m4 = (F.col(f"_{p}") for p in (1, 2, 3, 4))
    var = m2 - m1 * m1
    wide = F.when(var >= 0.5, var)
    return g.select(
        *keys, m1.alias("fft_centroid"), var.alias("fft_variance"),
        ((m3 - 3 * m1 * var - m1 * m1 * m1) / F.pow(wide, F.lit(1.5))).alias("fft_skew"),
        ((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4.0))) / (wide * wide)).alias("fft_kurtosis"))


def freq_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All frequency-domain features, one row per key."""
    keys = list(keys)
    out = simple(df, keys)
    rename = lambda d, pre: d.select(*keys, *[F.col(c).alias(f"{pre}{c}") for c in d.columns if c not in keys])
    for part in (entropy(df, keys), spread(df, keys), rolloff(df, keys), rename(peaks(df, keys), "spectral_"),
                 rename(psd(df, keys), "psd_"), magnitude_stats(df, keys)):
        out = out.join(part, keys, "left")
    return out
