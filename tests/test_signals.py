"""Transforms against NumPy and closed forms."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracework.functions import spectral as sp
from tracework.operators import features_time as ft
from tracework.operators import signals as sig
from tracework.operators import spectra


def series(spark, groups):
    rows = [(k, i, float(v)) for k, x in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, i long, v double")


def test_features_of_constant_sides(spark):
    """Correlations with a side that does not vary are undefined, not an error: even digit shares, constant and near-zero series."""
    d = series(spark, {"even": range(1, 10), "tiny": [5e-324, 3e-310, 2.0], "same": [2, 2, 2], "one": [4], "ones": [1, 10, 100, 2]})
    benford = {r["k"]: r["benford_correlation"] for r in ft.benford(d, ["k"], ["i"], "v").collect()}
    law = np.log10(1 + 1 / np.arange(1, 10))
    assert benford["even"] is None
    np.testing.assert_allclose(benford["ones"], np.corrcoef([3, 1] + [0] * 7, law)[0, 1])
    np.testing.assert_allclose(benford["tiny"], np.corrcoef(np.bincount([4, 3, 2], minlength=10)[1:], law)[0, 1])
    trend = {r["k"]: r["linear_trend_rvalue"] for r in ft.linear_trend(d, ["k"], ["i"], "v").collect()}
    assert trend["same"] == 0 and trend["one"] is None
    np.testing.assert_allclose(trend["ones"], np.corrcoef([1, 10, 100, 2], range(4))[0, 1])
    pairs = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 3.0, None), (1.0, 4.0, 7.0)], "a double, b double, c double")
    from tracework.operators.aggregates import corr_matrix

    assert [(r["a"], r["b"], r["r"] and round(r["r"], 9)) for r in corr_matrix(pairs, ["a", "b", "c"]).collect()] == [("a", "b", None), ("a", "c", None), ("b", "c", 1.0)]


@pytest.mark.parametrize("n", [1, 9, 25, 320, 321, 700])
def test_wavelet_mean(n):
    """Against the plain transform; kernels are made once, not once per series."""
    x = np.random.default_rng(n).normal(size=n)
    y, t, want = x[::10], np.linspace(-8.0, 8.0, 1024), []
    area = np.cumsum(np.exp(2j * np.pi * t - t * t / 1.5) / np.sqrt(np.pi * 1.5)) * (t[1] - t[0])
    for s in range(1, 64):
        pick = (np.arange(s * 16 + 1) / (s * (t[1] - t[0]))).astype(int)
        coef = -np.sqrt(s) * np.diff(np.convolve(y, area[pick[pick < len(area)]][::-1]))
        cut = (len(coef) - len(y)) / 2
        want.append(np.abs(coef[int(np.floor(cut)):len(coef) - int(np.ceil(cut))] if cut > 0 else coef).mean())
    assert sp.morlet_mean(x) == pytest.approx(np.mean(want), rel=1e-12)
    made = len(sp._WAVELETS), len(sp._SHORT)
    assert sp.morlet_mean(x + 1) and made == (len(sp._WAVELETS), len(sp._SHORT))


def test_results_leave_in_parts(spark, monkeypatch):
    """Long results of many rows are handed on in small parts, several functions at a time, in the rows' order."""
    monkeypatch.setattr(sig, "HANDED", 3)
    d = spark.range(0, 20, 1, 1).withColumn("x", F.when(F.col("id") % 7 != 3, F.sequence(F.lit(1), F.col("id") + 2).cast("array<double>")))
    many, size = sig.array_udf(lambda x: np.repeat(x.sum(), 4)), sig.array_udf(lambda x: float(len(x)), array=False)
    got = d.select("id", many("x").alias("m"), size("x").alias("n")).orderBy("id").collect()
    for r in got:
        n = r["id"] + 2
        assert (r["m"], r["n"]) == ((None, None) if r["id"] % 7 == 3 else ([n * (n + 1) / 2] * 4, n))
    seen = [len(part) for part in sig.array_udf(lambda x: x).func(iter([pd.Series([[1.0]] * 8)]))]
    assert seen == [3, 3, 2]


def test_wavelet_mean_travels_by_value(tmp_path):
    """A worker that does not find the library can still run it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "fn").write_bytes(cloudpickle.dumps(sp.morlet_mean))
    code = "import sys, pickle; assert abs(pickle.load(open('fn', 'rb'))(__import__('numpy').ones(400))) >= 0; assert 'tracework' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin"})


@pytest.mark.parametrize("n", [5, 16, 97, 250])
def test_long_transform_is_exact(spark, n):
    rng = np.random.default_rng(n)
    g = {"a": rng.normal(size=n), "b": rng.normal(size=n + 3)}
    d = series(spark, g).withColumnRenamed("k", "name")
    got = sig.long_rfft(d, ["name"], ["i"], "v").toPandas()
    for key, x in g.items():
        part = got[got["name"] == key].sort_values("k")
        z = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        np.testing.assert_allclose(z, np.fft.rfft(x), atol=1e-9)


def test_long_and_short_paths_agree(spark):
    rng = np.random.default_rng(0)
    d = series(spark, {"a": rng.normal(size=40), "b": rng.normal(size=200)}).withColumnRenamed("k", "name")
    clock = F.col("i") * 0.5
    a = sig.rfft(d, ["name"], ["i"], "v", clock).orderBy("name", "k").toPandas()
    b = sig.rfft(d, ["name"], ["i"], "v", clock, limit=100).orderBy("name", "k").toPandas()
    np.testing.assert_allclose(a[["f", "m"]], b[["f", "m"]], atol=1e-9)


def test_sine_peak(spark):
    x = np.sin(2 * np.pi * 8 * np.arange(128) / 128)
    d = series(spark, {"s": x}).withColumnRenamed("k", "name")
    m = sig.rfft(d, ["name"], ["i"], "v", F.col("i") / 128.0).orderBy(F.col("m").desc()).first()
    assert m["k"] == 8 and abs(m["f"] - 8) < 1e-9 and abs(m["m"] - 64) < 1e-9


def test_welch_segments_equal_array_version(small_ranges):
    x = np.random.default_rng(3).normal(size=300)
    d = series(small_ranges, {"s": x}).withColumnRenamed("k", "name")
    got = sig.welch(d, ["name"], ["i"], "v", fs=10.0, nperseg=64).orderBy("k").toPandas()
    np.testing.assert_allclose(got["psd"], sp.welch(x, 10.0, 64))
    assert abs(got["f"].iloc[-1] - 5.0) < 1e-12


def test_welch_keeps_power():
    x = np.random.default_rng(5).normal(size=256 * 40)
    p = sp.welch(x, 2.0)
    assert abs(p.sum() * 2.0 / 256 - x.var()) < 0.05 * x.var()


@pytest.mark.parametrize("n", [20, 33, 200, 301])
def test_stft_segments_equal_array_version(small_ranges, n):
    x = np.random.default_rng(n).normal(size=n)
    d = series(small_ranges, {"s": x}).withColumnRenamed("k", "name")
    got = sig.stft_mean(d, ["name"], ["i"], "v", nperseg=64).first()["stft_mean"]
    assert abs(got - sp.stft_mean(x, 64)) < 1e-12


@pytest.mark.parametrize("n,num", [(700, 512), (400, 512), (512, 512), (301, 512)])
def test_resample_band_limited_sine(n, num):
    t, u = np.arange(n) / n, np.arange(num) / num
    f = lambda s: 1.5 + np.sin(2 * np.pi * 5 * s) + 0.3 * np.cos(2 * np.pi * 11 * s)
    np.testing.assert_allclose(sp.resample(f(t), num), f(u), atol=1e-10)


def test_line_psd_parseval(spark):
    rng = np.random.default_rng(8)
    d = series(spark, {str(i): rng.normal(size=64) for i in range(5)}).withColumnRenamed("k", "line")
    spec = sig.line_psd(d, ["line"], ["i"], ["v"], 0.3)
    gap = spectra.parseval(d, spec, ["line"], "v", "phi_v", 0.3).toPandas()["relative_error"]
    assert gap.max() < 1e-12


def test_t_distribution(spark):
    one = lambda t: 1 - 2 / np.pi * np.arctan(t)  # noqa: E731 - closed forms for 1 and 3 degrees
    three = lambda t: 1 - 2 / np.pi * (t / np.sqrt(3) / (1 + t * t / 3) + np.arctan(t / np.sqrt(3)))
    d = spark.createDataFrame([(2.0, 1.0), (0.0, 5.0), (-2.5, 3.0), (0.1, 3.0), (40.0, 3.0)], "t double, n double")
    got = [r[0] for r in d.select(ft.t_two_sided("t", "n")).collect()]
    np.testing.assert_allclose(got, [one(2.0), 1.0, three(2.5), three(0.1), three(40.0)], atol=1e-12)


def test_wavelet_prefers_its_frequency():
    t = np.arange(2000)
    slow, none = np.sin(2 * np.pi * t / 200), np.zeros(2000)
    assert sp.morlet_mean(slow) > 10 * sp.morlet_mean(none) + 1e-6


def test_loglaw(spark):
    y = np.geomspace(1, 1000, 200)
    u = np.where(y < 11.0, y, np.log(y) / 0.41 + 5.2)
    d = spark.createDataFrame(pd.DataFrame({"y": y, "u": u}))
    r = spectra.loglaw_fit(d, "y", "u").first()
    assert abs(r["kappa"] - 0.41) < 1e-3 and abs(r["intercept"] - 5.2) < 0.02
    assert 10 < r["y_viscous"] < 12


def test_interpolation_extrapolates(small_ranges):
    c = small_ranges.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 2.0), ("a", 3.0, 4.0)], "g string, x double, y double")
    q = small_ranges.createDataFrame([("a", -1.0), ("a", 0.5), ("a", 2.0), ("a", 5.0)], "g string, x double")
    assert [r["y"] for r in spectra.interpolate(c, q, ["g"], "x", "y").orderBy("x").collect()] == [-2.0, 1.0, 3.0, 6.0]
