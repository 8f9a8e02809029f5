"""Stroke features: shape statistics, slopes, settling, crossings and peak segmentation."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions import spectral as sp
from tracework.functions.numeric import col, linear_bin
from tracework.operators import signals as sig
from tracework.operators.ordered import group_quantiles, ordered_columns
from tracework.operators.quality import with_group_stats

SETTLE_SHARE = 0.05


def basic(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Eleven shape statistics per stroke in one aggregation."""
    v, i = col(value), col(index)
    ends = (F.min_by(v, i) + F.max_by(v, i)) / 2
    abs_ends = (F.abs(F.min_by(v, i)) + F.abs(F.max_by(v, i))) / 2
    return df.groupBy(*keys).agg(
        F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        (F.max(v) - F.min(v)).alias("range"), F.sqrt(F.avg(v * v)).alias("rms"),
        (F.sum(v) - ends).alias("area"), (F.sum(F.abs(v)) - abs_ends).alias("abs_area"),
        F.max_by(i, F.struct(v, -i)).alias("peak_index"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))


def _peak(df, keys, index, value):
    v, i = col(value), col(index)
    return df.groupBy(*keys).agg(
        F.max_by(i, F.struct(v, -i)).alias("pk"), F.max(v).alias("xp"), F.min_by(v, i).alias("x0"),
        F.max_by(v, i).alias("xe"), F.count(F.lit(1)).alias("n"))


def slopes(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Rise to the first maximum and fall behind it; 0 when the peak is within 5 points of the edge."""
    p = _peak(df, keys, index, value)
    up = F.when(F.col("pk") > 5, (F.col("xp") - F.col("x0")) / F.when(F.col("pk") != 0, F.col("pk"))).otherwise(0.0)
    down = F.when(F.col("pk") < F.col("n") - 5, (F.col("xe") - F.col("xp")) / (F.col("n") - F.col("pk"))).otherwise(0.0)
    return p.select(*keys, up.alias("loading_slope"), down.alias("unloading_slope"))


def settling(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Points from the peak until the signal first falls below 5% of it, else to the end."""
    p = _peak(df, keys, index, value)
    i, v = col(index), col(value)
    calm = F.min(F.when((i >= F.col("pk")) & (F.abs(v) < SETTLE_SHARE * F.abs("xp")), i))
    g = df.join(p, list(keys)).groupBy(*keys).agg((F.coalesce(calm, F.max("n")) - F.max("pk")).cast("int").alias("settling"))
    return g


def zero_crossings(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    d = ordered_columns(df, keys, order, lag={"_p": value})
    cross = F.count_if(F.signum(value) != F.signum("_p"))
    return d.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), cross.alias("crossings"),
        (cross / F.count(F.lit(1))).alias("zcr"))


def fft_bands(df: DataFrame, keys: Sequence[str], index: str, value: str, low: int = 20, mid: int = 80) -> DataFrame:
    """Energy of the centred spectrum: total and three bands split at bins 1, ``low`` and ``mid``."""

    def energy(x: np.ndarray) -> np.ndarray:
        return np.abs(np.fft.rfft(x - x.mean())) ** 2

    e = sig.series_arrays(df, keys, [index], value).select(*keys, F.posexplode(sig.array_udf(energy)("x")).alias("b", "e"))
    b = F.col("b")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("e"))), F.lit(0.0))
    return e.groupBy(*keys).agg(
        F.sum("e").alias("energy_total"), part((b >= 1) & (b < low)).alias("energy_low"),
        part((b >= low) & (b < mid)).alias("energy_mid"), part(b >= mid).alias("energy_high"))


def dominant_bin(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Bin of the largest magnitude in the first half of the transform."""
    half = sig.array_udf(lambda x: np.abs(np.fft.fft(x))[: max(1, len(x) // 2)])
    e = sig.series_arrays(df, keys, [index], value).select(*keys, half("x").alias("m"))
    return e.select(*keys, (F.array_position("m", F.array_max("m")) - 1).cast("int").alias("dominant"))


def relative_windows(df: DataFrame, keys: Sequence[str], clock: str, width: int) -> DataFrame:
    from tracework.operators.windows import tumbling

    return tumbling(df, keys, clock, width)


def window_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Eight plain features per window, including the entropy of its own ten-bin histogram."""
    keys, v = list(keys), F.col(value)
    d = ordered_columns(df, keys, order, lag={"_p": value})
    base = d.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.kurtosis(v).alias("kurtosis"), F.skewness(v).alias("skewness"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.count_if(F.signum(v) != F.signum("_p")).alias("zcr"))
    mid = group_quantiles(df, keys, value, {"median": 0.5})
    lim = with_group_stats(df, keys, F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    cell = F.when(F.col("_hi") > F.col("_lo"), linear_bin(v, F.col("_lo"), F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")), 10)).otherwise(5)
    cells = lim.groupBy(*keys, cell.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    # entropy of shares: ln T - sum c ln c / T
    ent = cells.groupBy(*keys).agg((F.ln(F.sum("_c")) - F.sum(F.col("_c") * F.ln("_c")) / F.sum("_c")).alias("entropy"))
    return base.join(mid, keys).join(ent, keys)


def window_spectral(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fs: float) -> DataFrame:
    """Mean Welch density, mean short-time magnitude and mean wavelet magnitude of bounded windows."""
    a = sig.series_arrays(df, keys, order, value)
    scalar = lambda fn: sig.array_udf(fn, array=False)("x")
    return a.select(*keys, scalar(lambda x: float(sp.welch(x, fs).mean())).alias("psd_mean"),
                    scalar(sp.stft_mean).alias("stft_mean"), scalar(sp.morlet_mean).alias("wavelet_mean"))


def select_relevant(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, label: str, top: int) -> DataFrame:
    """Impute window features by their mean and keep the ``top`` most label-relevant ones."""
    from pyspark.ml.feature import Imputer, UnivariateFeatureSelector, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stats = window_stats(df, keys, order, value)
    lab = df.groupBy(*keys).agg(F.mode(label, deterministic=True).cast("double").alias("_y"))
    cols = [c for c in stats.columns if c not in keys]
    d = stats.join(lab, list(keys)).select(*keys, "_y", *[F.col(c).cast("double").alias(c) for c in cols])
    d = Imputer(inputCols=cols, outputCols=cols).fit(d).transform(d)
    vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(d)
    sel = UnivariateFeatureSelector(featuresCol="_x", outputCol="_o", labelCol="_y", selectionMode="numTopFeatures")
    model = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top).fit(vec)
    names = [cols[i] for i in model.selectedFeatures]
    arr = model.transform(vec).withColumn("_a", vector_to_array("_o"))
    return arr.select(*keys, F.col("_y").cast("int").alias("label"), *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])
