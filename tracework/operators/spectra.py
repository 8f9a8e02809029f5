"""Simulation fields: cell lines, spectra grids, slopes, interpolation and wall profiles."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.operators.ordered import group_quantiles, ordered_columns, range_count
from tracework.operators.windows import centred, first_long_run

# Quadratic Savitzky-Golay weights over 11 points, divided by 429.
SAVGOL_11 = (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)
KAPPA = 0.41
KOLMOGOROV = -5.0 / 3.0


def level_tolerance(df: DataFrame, coord: str) -> DataFrame:
    """One row: a quarter of the 1st percentile of the gaps between distinct levels (1e-9 without gaps)."""
    levels = df.select(F.col(coord).cast("double").alias("x")).distinct()
    gaps = ordered_columns(levels, [], ["x"], lag={"p": "x"}).select((F.col("x") - F.col("p")).alias("g")).where("g > 0")
    return group_quantiles(gaps, [], "g", {"q": 0.01}).select(F.coalesce(F.col("q") * 0.25, F.lit(1e-9)).alias("tol"))


def quantize(df: DataFrame, coord: str, tol: Column, out: str) -> DataFrame:
    """Level number: coordinate over tolerance, half to even."""
    return df.withColumn(out, F.bround(F.col(coord) / tol).cast("long"))


def cell_lines(df: DataFrame, x: str, y: str, z: str, weight: str, time: str,
               values: Sequence[str], tol: Mapping[str, float] | None = None) -> DataFrame:
    """Cells grouped into x-lines: one row per (time, line, plane) with values averaged per plane.

    A line carries its weighted position and is kept only where every x-plane is filled.
    """
    tol = tol or {}
    for c, out in ((x, "_xq"), (y, "yq"), (z, "zq")):
        t = F.lit(tol[c]) if c in tol else level_tolerance(df, c).scalar()
        df = quantize(df, c, t, out)
    planes = ordered_columns(df.select("_xq").distinct(), [], ["_xq"], index="plane")
    cells = df.join(planes, "_xq").groupBy(time, "yq", "zq", "plane").agg(
        *[F.avg(v).alias(v) for v in values], F.sum(weight).alias("_w"),
        F.sum(F.col(weight) * F.col(y)).alias("_wy"), F.sum(F.col(weight) * F.col(z)).alias("_wz"),
        F.sum(y).alias("_sy"), F.sum(z).alias("_sz"), F.count(F.lit(1)).alias("_c"))
    total = F.sum("_w")
    rep = lambda wv, sv: F.when(total > 0, F.sum(wv) / F.when(total != 0, total)).otherwise(F.sum(sv) / F.sum("_c"))
    lines = cells.groupBy(time, "yq", "zq").agg(
        F.count(F.lit(1)).alias("planes"), rep("_wy", "_sy").alias("y_rep"), rep("_wz", "_sz").alias("z_rep"),
        F.when(total > 0, total).otherwise(F.sum("_c").cast("double")).alias("w_rep"))
    full = planes.agg(F.count(F.lit(1))).scalar()
    lines = lines.withColumn("complete", F.col("planes") == full)
    return cells.drop("_w", "_wy", "_wz", "_sy", "_sz", "_c").join(lines, [time, "yq", "zq"])


def parseval(df: DataFrame, spectra: DataFrame, keys: Sequence[str], value: str, phi: str, dk: float) -> DataFrame:
    """Variance in physical and in spectral space and their relative difference."""
    phys = df.groupBy(*keys).agg(F.var_pop(value).alias("physical"))
    spec = spectra.groupBy(*keys).agg((F.sum(phi) * F.lit(dk)).alias("spectral"))
    gap = F.abs(F.col("physical") - F.col("spectral")) / F.greatest(F.abs("physical"), F.lit(1e-300))
    return phys.join(spec, list(keys)).withColumn("relative_error", gap)


def premultiplied(df: DataFrame, k: str, comps: Sequence[str], u_tau: float) -> DataFrame:
    """k Phi / u_tau^2 per component, their total and the component shares."""
    scale = F.col(k) / F.lit(u_tau * u_tau)
    total = sum(F.col(c) for c in comps)
    return df.withColumns({
        **{f"pre_{c}": scale * F.col(c) for c in comps}, "pre_total": scale * total,
        **{f"share_{c}": F.when(total != 0, F.col(c) / total) for c in comps}})


def anisotropy(df: DataFrame, num: str, den: str, floor: float = 1e-30, rel: float = 1e-6) -> DataFrame:
    """log10(num/den) where both exceed an absolute and a relative floor, else null."""
    top = df.agg(F.struct(F.max(num).alias("n"), F.max(den).alias("d"))).scalar()
    df = df.withColumn("_m", top)
    ok = (F.col(num) > F.greatest(F.lit(floor), F.lit(rel) * F.col("_m.n"))) & (
        F.col(den) > F.greatest(F.lit(floor), F.lit(rel) * F.col("_m.d")))
    return df.withColumn("log_ratio", F.when(ok, F.log10(F.col(num) / F.when(ok, F.col(den))))).drop("_m")


def inertial_slope(df: DataFrame, keys: Sequence[str], k: str, phi: str, weight: str, d: str,
                   band: tuple[float, float], k_range: tuple[float, float], min_points: int = 6) -> DataFrame:
    """Log-log slope of the band-averaged density and its distance from -5/3."""
    keys = list(keys)
    inside = df.where(F.col(d).between(*band) & (F.col(weight) > 0))
    curve = inside.groupBy(*keys, k).agg((F.sum(F.col(phi) * F.col(weight)) / F.sum(weight)).alias("_phi"))
    fit = curve.where(F.col(k).between(*k_range) & (F.col(k) > 0) & (F.col("_phi") > 0))
    n, slope = F.count(F.lit(1)), F.regr_slope(F.log10("_phi"), F.log10(k))
    g = fit.groupBy(*keys).agg(n.alias("points"), F.when(n >= min_points, slope).alias("slope"))
    return g.withColumn("delta", F.col("slope") - F.lit(KOLMOGOROV))


def tail_box(df: DataFrame, k: str, d: str, q: str, k_box: tuple[float, float], d_box: tuple[float, float],
             tail_min: float) -> tuple[DataFrame, DataFrame]:
    """High-wavenumber tail in a (k, d) box: the mean/median curve, and its one-row verdict."""
    box = df.where(F.col(k).between(*k_box) & F.col(d).between(*d_box))
    mean = box.groupBy(k).agg(F.avg(q).alias("mean_curve"))
    curve = mean.join(group_quantiles(box, [k], q, {"median_curve": 0.5}), k)
    peak = df.where(F.col(d).between(*d_box)).groupBy(k).agg(F.avg(q).alias("_m")).agg(F.max("_m")).scalar()
    tail = ordered_columns(mean.where(F.col(k) >= tail_min), [], [k], lag={"_p": "mean_curve"})
    step = F.col("mean_curve") - F.col("_p")
    s = tail.agg(F.avg("mean_curve").alias("tail_mean"), F.max_by("mean_curve", k).alias("tail_last"),
                 F.avg(F.when(step <= 0, 1.0).when(step > 0, 0.0)).alias("frac_nonincreasing"))
    s = s.withColumn("_peak", peak).withColumn("r_tail", F.when(F.col("_peak") > 0, F.col("tail_mean") / F.when(F.col("_peak") > 0, F.col("_peak"))))
    level = F.when(F.col("r_tail") < 0.05, "very small").when(F.col("r_tail") < 0.15, "reduced").otherwise("elevated")
    return curve, s.withColumn("verdict", F.when(F.col("r_tail").isNotNull(), level)).drop("_peak")


def nearest_pick(df: DataFrame, value: str, requests: Sequence[float], *cols: str) -> DataFrame:
    """For each requested number the row nearest in ``value`` (the smaller one on ties)."""
    v = F.col(value)
    row = F.struct(v.alias(value), *cols)
    picks = df.agg(F.array(*[
        F.struct(F.lit(float(r)).alias("requested"), F.min_by(row, F.struct(F.abs(v - F.lit(float(r))), v)).alias("p"))
        for r in requests]).alias("a"))
    return picks.select(F.explode("a").alias("a")).select("a.requested", "a.p.*")


def log_limits(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Percentiles of log10 of the positive values (colour limits)."""
    d = df.where(F.col(value) > 0).select(F.log10(value).alias("_l"))
    return group_quantiles(d, [], "_l", {"low": low, "high": high})


def interpolate(curves: DataFrame, grid: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Curve values at grid points, linear between neighbours and along the end pairs outside.

    Built like a nearest-in-time join: segments and grid points are stacked and the
    governing segment is carried along the axis.
    """
    keys = list(keys)
    ranges = range_count(curves)
    seg = ordered_columns(curves.select(*keys, x, y), keys, [x], ranges=ranges, lead={"_x1": x, "_y1": y}).where(F.col("_x1").isNotNull())
    left = seg.select(*keys, F.col(x).alias("_x"), F.lit(0).alias("_side"), F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("_x1").alias("x1"), F.col("_y1").alias("y1")).alias("_s"))
    right = grid.select(*keys, F.col(x).alias("_x"), F.lit(1).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = ordered_columns(both, keys, ["_x", "_side"], ranges=ranges, last={"_a": "_s"}, next={"_b": "_s"})
    s = F.coalesce("_a", "_b")
    val = s["y0"] + (s["y1"] - s["y0"]) / (s["x1"] - s["x0"]) * (F.col("_x") - s["x0"])
    return both.where("_side = 1").select(*keys, F.col("_x").alias(x), val.alias(y))


def common_grid_mean(curves: DataFrame, key: str, k: str, e: str, points: int = 300) -> DataFrame:
    """Mean of all curves on a logarithmic grid over the shared k range."""
    ends = curves.groupBy(key).agg(F.min(k).alias("a"), F.max(k).alias("b"))
    lim = ends.agg(F.struct(F.max("a").alias("lo"), F.min("b").alias("hi"))).scalar()
    step = (F.log10(F.col("_l.hi")) - F.log10(F.col("_l.lo"))) / (points - 1)
    idx = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = ends.select(key, lim.alias("_l")).where("_l.hi > _l.lo").select(key, "_l", idx.alias("g"))
    grid = grid.select(key, "g", F.pow(F.lit(10.0), F.log10(F.col("_l.lo")) + F.col("g") * step).alias(k))
    got = interpolate(curves, grid, [key], k, e)
    return got.groupBy(k).agg(F.avg(e).alias(e))


def gradient(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Index gradient: central differences inside, one-sided at both ends."""
    d = ordered_columns(df, keys, order, lag={f"_b{v}": v for v in values}, lead={f"_a{v}": v for v in values})
    grads = {}
    for v in values:
        b, a = F.col(f"_b{v}"), F.col(f"_a{v}")
        grads[f"d_{v}"] = F.when(b.isNull(), a - F.col(v)).when(a.isNull(), F.col(v) - b).otherwise((a - b) / 2)
    return d.withColumns(grads).drop(*[f"_{s}{v}" for v in values for s in "ab"])


def savgol(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str) -> DataFrame:
    """Quadratic smoothing over 11 points; null where the window is not full."""
    d = centred(df, keys, index, 5, {"_w": lambda w: F.collect_list(F.coalesce(F.col(value), F.lit(math.nan))).over(w)})
    weights = F.array(*[F.lit(c / 429.0) for c in SAVGOL_11])
    dot = F.aggregate(F.zip_with("_w", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return d.withColumn(out, F.when(F.size("_w") == 11, dot)).drop("_w")


def loglaw_fit(df: DataFrame, y_plus: str, u_plus: str, tol: float = 0.35, min_len: int = 12) -> DataFrame:
    """kappa and B of the first long slope plateau near 1/0.41, and where U+ crosses y+ = U+.

    ``df`` holds one profile, the y+ levels averaged beforehand.
    """
    d = df.withColumn("_ly", F.ln(y_plus)).select(F.col(y_plus).alias("y"), F.col(u_plus).alias("u"), "_ly")
    d = gradient(d, [], ["y"], ["u", "_ly"])
    d = ordered_columns(d, [], ["y"], index="i").withColumn("_s", F.when(F.col("d__ly") != 0, F.col("d_u") / F.when(F.col("d__ly") != 0, F.col("d__ly"))))
    d = savgol(d, [], "i", "_s", "slope")
    flag = (F.abs(F.col("slope") - F.lit(1 / KAPPA)) < tol) & (F.col("y") > 30)
    d = d.withColumn("_in", F.coalesce(flag, F.lit(False)))
    block = first_long_run(d, [], ["y"], "_in", min_len)
    lim = block.agg(F.struct(F.max("start").alias("s"), F.max("end").alias("e"))).scalar()
    inside = F.col("i").between(F.col("_b.s"), F.col("_b.e"))
    slope = F.regr_slope(F.when(inside, F.col("u")), F.when(inside, F.col("_ly")))
    icept = F.regr_intercept(F.when(inside, F.col("u")), F.when(inside, F.col("_ly")))
    fit = d.withColumn("_b", lim).agg(
        F.min(F.when(inside, F.col("y"))).alias("y_start"), F.max(F.when(inside, F.col("y"))).alias("y_end"),
        F.when(slope != 0, 1 / slope).alias("kappa"), icept.alias("intercept"))
    g = d.withColumn("_g", F.col("u") - F.col("y"))
    g = ordered_columns(g.select("y", "_g"), [], ["y"], lead={"_y1": "y", "_g1": "_g"})
    cross = F.when((F.col("_g") >= 0) & (F.col("_g1") < 0), F.col("y") + F.col("_g") / (F.col("_g") - F.col("_g1")) * (F.col("_y1") - F.col("y")))
    return fit.withColumn("y_viscous", g.agg(F.min(cross)).scalar())


def time_steps(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Smallest, largest and mean step between distinct times."""
    d = ordered_columns(df.select(*keys, time).distinct(), keys, [time], lag={"_p": time})
    s = F.col(time) - F.col("_p")
    return d.groupBy(*keys).agg(F.min(s).alias("min_step"), F.max(s).alias("max_step"), F.avg(s).alias("mean_step"))
