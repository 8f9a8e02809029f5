"""Spectra of series: arrays per bounded series, segment-parallel Welch, distributed transform for long ones."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tracework.functions import spectral as sp
from tracework.operators.ordered import ordered_columns
from tracework.session import materialise

HANDED = 256  # series whose results leave a task at a time
SHORT = 4096  # points up to which series are stacked
MAX_POINTS = 2_000_000  # longest series handled as one array (16 MB of doubles)


def array_udf(fn: Callable[[np.ndarray], np.ndarray | float], array: bool = True):
    """Arrow-batched function of one array column."""

    @F.pandas_udf(ArrayType(DoubleType()) if array else DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:  # results leave the task in small parts: a row may become a long array
            for at in range(0, len(s), HANDED):
                yield s.iloc[at:at + HANDED].map(lambda a: None if a is None or len(a) == 0 else fn(np.asarray(a, dtype=float)))

    return run


@F.pandas_udf(ArrayType(DoubleType()))
def half_spectra(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Magnitudes of the half spectrum; short series of equal length are one array."""
    for s in batches:
        for at in range(0, len(s), HANDED):
            part = s.iloc[at:at + HANDED].to_numpy()
            out, sizes = np.empty(len(part), object), np.array([0 if a is None else len(a) for a in part])
            for n in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == n)
                for some in [rows] if n <= SHORT else rows[:, None]:
                    out[some] = [*np.abs(np.fft.rfft(np.stack([np.asarray(part[i], float) for i in some]), axis=1))]
            yield pd.Series(out)


def series_arrays(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **aggs: Column) -> DataFrame:
    """One row per series of bounded length: values in order plus further named aggregates."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(*keys).agg(rows.alias("_rows"), *[c.alias(a) for a, c in aggs.items()]).select(
        *keys, F.transform("_rows", lambda r: r["_v"]).alias("x"), *aggs)


def split_by_length(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of series up to ``limit`` points, and the rest (None if there is none)."""
    if df.count() <= limit:
        return df, None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > limit).drop("_c")
    if sizes.isEmpty():
        return df, None
    sizes = materialise(sizes, "long-series")
    return df.join(sizes, list(keys), "left_anti"), df.join(sizes, list(keys), "left_semi")


def rfft(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, clock_s: Column, limit: int = MAX_POINTS) -> DataFrame:
    """Half spectrum per series: bin k, frequency f (rate = 1 / mean step) and magnitude m."""
    step = ((F.max(clock_s) - F.min(clock_s)) / F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1)) - 1))
    short, long = split_by_length(df, keys, limit)
    arr = series_arrays(short, keys, order, value, dt=step)
    mags = arr.withColumn("n", F.size("x")).withColumn("m", half_spectra("x"))
    out = mags.select(*keys, "n", "dt", F.posexplode("m").alias("k", "m"))
    if long is not None:
        base = long.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), step.alias("dt"))
        spec = long_rfft(long, keys, order, value).join(base, list(keys))
        out = out.unionByName(spec.select(*keys, "n", "dt", F.col("k").cast("int").alias("k"), F.hypot("re", "im").alias("m")))
    freq = F.col("k") / (F.col("n") * F.when(F.col("dt") != 0, F.col("dt")))
    return out.select(*keys, "k", freq.alias("f"), "m")


# --- transform of a series too long for one task -------------------------------------------

def _power2(m: Column) -> Column:
    return F.pow(F.lit(2.0), m).cast("long")


def _pass(df: DataFrame, keys: Sequence[str], inverse: bool) -> DataFrame:
    """Power-of-two transform of rows (keys, m = log2 length, j, re, im) in two grouped passes.

    Columns of about sqrt(length) points are transformed, turned by the twiddle factor and
    transformed across; no group exceeds that size.  Absent positions count as zero.
    """
    sign = 1.0 if inverse else -1.0
    fft = (lambda v: np.fft.ifft(v) * len(v)) if inverse else np.fft.fft
    cols = _power2(F.col("m") - F.floor(F.col("m") / 2))
    d = df.withColumn("a", F.floor(F.col("j") / cols).cast("long")).withColumn("b", F.col("j") % cols)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    out_schema = f"{key_schema}, m int, a long, b long, re double, im double"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        m, b = int(pdf["m"].iloc[0]), int(pdf["b"].iloc[0])
        r = 1 << (m // 2)
        v = np.zeros(r, dtype=complex)
        v[pdf["a"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k1 = np.arange(r)
        v = fft(v) * np.exp(sign * 2j * np.pi * (b * k1 % (1 << m)) / (1 << m))
        return _frame(pdf, keys, m, k1, np.full(r, b), v)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        m, k1 = int(pdf["m"].iloc[0]), int(pdf["a"].iloc[0])
        r, c = 1 << (m // 2), 1 << (m - m // 2)
        v = np.zeros(c, dtype=complex)
        v[pdf["b"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        v = fft(v)
        if inverse:
            v /= 1 << m
        return _frame(pdf, keys, m, k1 + r * np.arange(c), np.zeros(c, dtype=int), v)

    mid = d.select(*keys, "m", "a", "b", "re", "im").groupBy(*keys, "b").applyInPandas(first, out_schema)
    return mid.groupBy(*keys, "a").applyInPandas(second, out_schema).select(*keys, "m", F.col("a").alias("j"), "re", "im")


def _frame(pdf, keys, m, a, b, v):
    out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(v) for k in keys})
    out["m"], out["a"], out["b"], out["re"], out["im"] = m, a, b, v.real, v.imag
    return out.astype({"m": "int32", "a": "int64", "b": "int64"})


def long_rfft(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Exact half spectrum of series of any length: chirp products around a power-of-two convolution."""
    keys = list(keys)
    x = ordered_columns(df.select(*keys, *order, value), keys, order, index="j", total={"n": ("count", F.lit(1))})
    m = F.ceil(F.log2(2.0 * F.col("n"))).cast("int")
    # the angle pi j^2 / n is reduced as an integer first to stay exact
    angle = F.lit(np.pi) * (((F.col("j") % (2 * F.col("n"))).cast("decimal(38,0)") * F.col("j")) % (2 * F.col("n"))).cast("double") / F.col("n")
    x = materialise(x.select(*keys, "n", m.alias("m"), "j", F.col(value).cast("double").alias("v"),
                             F.cos(angle).alias("c"), F.sin(angle).alias("s")), "chirp")
    a = x.select(*keys, "m", "j", (F.col("v") * F.col("c")).alias("re"), (-F.col("v") * F.col("s")).alias("im"))
    size = _power2(F.col("m"))
    where = F.explode(F.when(F.col("j") == 0, F.array(F.col("j"))).otherwise(F.array(F.col("j"), size - F.col("j"))))
    b = x.select(*keys, "m", where.alias("j"), F.col("c").alias("re"), F.col("s").alias("im"))
    fa = _pass(a, keys, False)
    fb = _pass(b, keys, False).select(*keys, "j", F.col("re").alias("br"), F.col("im").alias("bi"))
    prod = fa.join(fb, [*keys, "j"]).select(
        *keys, "m", "j", (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"),
        (F.col("re") * F.col("bi") + F.col("im") * F.col("br")).alias("im"))
    conv = _pass(prod, keys, True).select(*keys, "j", "re", "im")
    half = x.where(F.col("j") <= F.floor(F.col("n") / 2)).select(*keys, "j", "c", "s")
    got = conv.join(half, [*keys, "j"])
    return got.select(*keys, F.col("j").alias("k"), (F.col("re") * F.col("c") + F.col("im") * F.col("s")).alias("re"),
                      (F.col("im") * F.col("c") - F.col("re") * F.col("s")).alias("im"))


# --- segment-parallel estimates ------------------------------------------------------------

def _segments(df, keys, order, value, nperseg, pad):
    """Each sample goes to every segment covering it: (keys, seg, pos, v, n, size)."""
    d = ordered_columns(df, keys, order, index="_i", total={"n": ("count", F.lit(1))})
    size = F.least(F.lit(nperseg), F.col("n").cast("int"))
    step = size - F.floor(size / 2).cast("int")
    at = F.col("_i") + (F.floor(size / 2) if pad else F.lit(0))
    lo = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("long")
    hi = F.floor(at / step).cast("long")
    d = d.withColumns({"size": size, "_step": step, "_at": at}).withColumn("seg", F.explode(F.sequence(lo, hi)))
    d = d.withColumn("pos", (F.col("_at") - F.col("seg") * F.col("_step")).cast("int"))
    if pad:
        ext = F.col("n") + 2 * F.floor(F.col("size") / 2)
        extra = F.pmod(F.pmod(-(ext - F.col("size")), F.col("_step")), F.col("size"))
        count = F.floor((ext + extra - F.col("size")) / F.col("_step")) + 1
    else:
        count = F.floor((F.col("n") - F.col("size")) / F.col("_step")) + 1
    return d.withColumn("segs", count.cast("long")).where(F.col("seg") < F.col("segs"))


def welch(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fs: float = 1.0, nperseg: int = 256) -> DataFrame:
    """Averaged periodogram per series (keys, k, f, psd); segments of one series run in parallel."""
    d = _segments(df, keys, order, value, nperseg, pad=False)
    seg = series_arrays(d, [*keys, "seg", "size"], ["pos"], value)
    p = seg.withColumn("p", array_udf(lambda x: sp.psd_segment(x, fs))("x"))
    long = p.select(*keys, "size", F.posexplode("p").alias("k", "p"))
    return long.groupBy(*keys, "k").agg(F.avg("p").alias("psd"), F.max("size").alias("_s")).select(
        *keys, "k", (F.col("k") * F.lit(float(fs)) / F.col("_s")).alias("f"), "psd")


def stft_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, nperseg: int = 256) -> DataFrame:
    """Mean short-time magnitude per series; edge segments are zero padded, empty ones count as 0."""
    d = _segments(df, keys, order, value, nperseg, pad=True)
    cells = F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))
    seg = d.groupBy(*keys, "seg", "size", "segs").agg(cells.alias("c"))
    blank = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.lit(0.0))
    filled = F.map_from_entries("c")
    x = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at(filled, i), F.element_at(blank, 1)))

    def total(v: np.ndarray) -> float:
        w = sp.hann(len(v))
        return float(np.abs(np.fft.rfft(v * w)).sum() / w.sum())

    s = seg.withColumn("t", array_udf(total, array=False)(x))
    return s.groupBy(*keys).agg((F.sum("t") / (F.max("segs") * (F.floor(F.max("size") / 2) + 1))).alias("stft_mean"))


def cwt_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean Morlet magnitude of bounded windows."""
    return series_arrays(df, keys, order, value).select(*keys, array_udf(sp.morlet_mean, array=False)("x").alias("cwt_mean"))


def resampled(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, num: int = 512) -> DataFrame:
    """Strokes (length bounded by the quality rules) brought to ``num`` points."""
    return series_arrays(df, keys, order, value).select(*keys, array_udf(lambda x: sp.resample(x, num))("x").alias("x"))


def baseline(arr: Column | str, head: int = 80) -> Column:
    """Array minus the mean of its first ``head`` values."""
    a = F.col(arr) if isinstance(arr, str) else arr
    first = F.slice(a, 1, head)
    mean = F.aggregate(first, F.lit(0.0), lambda s, v: s + v) / F.size(first)
    return F.transform(a, lambda v: v - mean)


def line_spectrum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, spacing: float) -> DataFrame:
    """One-sided Hann energy spectrum per line with window power correction; k = 0 dropped."""

    def energy(u: np.ndarray) -> np.ndarray:
        n = len(u)
        w = sp.hann(n)
        e = spacing / (n * np.mean(w * w)) * np.abs(np.fft.rfft((u - u.mean()) * w)) ** 2
        return sp.one_sided(e, n, keep_last=True)[1:]

    a = series_arrays(df, keys, order, value).withColumn("n", F.size("x"))
    e = a.withColumn("e", array_udf(energy)("x"))
    return e.select(*keys, "n", F.posexplode("e").alias("b", "e")).select(
        *keys, (2 * F.lit(np.pi) * (F.col("b") + 1) / (F.col("n") * F.lit(spacing))).alias("k"), "e")


def line_psd(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], dk: float) -> DataFrame:
    """Spectral density per line and component: mean removed, |F/n|^2, interior doubled, / dk."""

    def density(u: np.ndarray) -> np.ndarray:
        n = len(u)
        return sp.one_sided(np.abs(np.fft.rfft(u - u.mean()) / n) ** 2, n, keep_last=True) / dk

    long = df.unpivot([*keys, *order], list(values), "component", "v")
    a = series_arrays(long, [*keys, "component"], order, "v")
    p = a.select(*keys, "component", F.posexplode(array_udf(density)("x")).alias("b", "phi"))
    return p.groupBy(*keys, "b").pivot("component", list(values)).agg(F.first("phi")).select(
        *keys, "b", *[F.col(v).alias(f"phi_{v}") for v in values])
