"""Spectra and frequency-domain features on (part, channel) series."""
from pyspark.sql import functions as F

from tracework.operators import features_freq as ff
from tracework.operators import features_time as ft
from tracework.operators import signals as sig
from tracework.operators import strokes as st
from tracework.plans.registry import outputs, query
from tracework.session import materialise

KEYS, ORD = ["part", "channel"], ["us", "event_id"]


def spectrum(t):
    """Half spectrum of every series; frequencies per hour."""
    return sig.rfft(t.series, KEYS, ORD, "v", F.col("us") / 3.6e9)


def kept_spectrum(t):
    """The spectrum, written down once for features that read it several times."""
    return materialise(spectrum(t), "spectrum")


SPEC = """WITH s AS (SELECT user_id AS part, event_type AS channel, value AS v, epoch_us(ts) AS us,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
h AS (SELECT part, channel, max(n) AS n, CASE WHEN max(n) > 1 THEN (max(us)/3.6e9::DOUBLE - min(us)/3.6e9::DOUBLE) / (max(n) - 1) END AS dt FROM s GROUP BY 1, 2),
kk AS (SELECT part, channel, n, dt, unnest(range(n // 2 + 1)) AS k FROM h),
d AS (SELECT part, channel, k, max(kk.n) AS n, max(dt) AS dt, sum(v * cos(2 * pi() * ((i * k) % s.n) / s.n)) AS re, sum(v * sin(2 * pi() * ((i * k) % s.n) / s.n)) AS im
 FROM kk JOIN s USING (part, channel) GROUP BY 1, 2, 3),
x AS (SELECT part, channel, k, k / (n * dt) AS f, sqrt(re*re + im*im) AS m, re*re + im*im AS e, count(*) OVER (PARTITION BY part, channel) AS nb FROM d)
"""


def R(e, d=4, nudge=""):
    return f"round({e}{nudge}, {d}) + 0.0"


TIE = 3e-7  # energies of short series are short decimals: see outputs(nudge=..)
TIE_SQL = " + 3e-7::DOUBLE"


@query("sig_rfft", SPEC + f"SELECT part, channel, k::INTEGER AS k, {R('f', 6)} AS f, {R('m')} AS m FROM x")
def _(t):
    return outputs(spectrum(t), 4, f=6)


def one(name, expr, digits=4):
    return f"{SPEC}SELECT part, channel, {R(expr, digits, TIE_SQL if name == 'spectral_energy' else '')} AS {name} FROM x GROUP BY 1, 2"


SIMPLE = {
    "fundamental_frequency": ("arg_max(f, (m, -k))", 6), "peak_frequency": ("arg_max(f, (m, -k))", 6),
    "spectral_energy": ("sum(e) / count(*)", 4), "spectral_centroid": ("sum(abs(f)*e) / sum(e)", 6),
    "spectral_flatness": ("exp(avg(ln(m)) FILTER (m > 0)) / avg(m)", 5),
    "spectral_skewness": ("CASE WHEN stddev_pop(m) > 0 THEN (avg(m*m*m) - 3*avg(m)*avg(m*m) + 2*avg(m)**3) / power(var_pop(m), 1.5) END", 4),
    "spectral_kurtosis": ("CASE WHEN stddev_pop(m) > 0 THEN kurtosis_pop(m) END", 4),
    "weighted_mean_frequency": ("sum(f*m) / sum(m)", 6), "coeff_variation": ("stddev_pop(m) / avg(m)", 6),
}


def _simple(name, digits):
    expr = SIMPLE[name][0]

    @query(f"ffd_{name}", one(name, expr, digits))
    def _(t):
        d = ff.simple(spectrum(t), KEYS).select(*KEYS, name)
        return outputs(d, digits, nudge=TIE if name == "spectral_energy" else 0.0)


for _n, (_e, _d) in SIMPLE.items():
    _simple(_n, _d)


@query("ffd_spectral_entropy", SPEC + f""", q AS (SELECT *, e / sum(e) OVER (PARTITION BY part, channel) AS p FROM x)
SELECT part, channel, {R('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)', 5)} AS spectral_entropy FROM q GROUP BY 1, 2""")
def _(t):
    return outputs(ff.entropy(spectrum(t), KEYS), 5)


@query("ffd_spectral_spread", SPEC + f""", c AS (SELECT part, channel, sum(abs(f)*e)/sum(e) AS c FROM x GROUP BY 1, 2)
SELECT part, channel, {R('sqrt(sum((f-c)*(f-c)*e)/sum(e))', 6)} AS spectral_spread FROM x JOIN c USING (part, channel) GROUP BY 1, 2""")
def _(t):
    return outputs(ff.spread(spectrum(t), KEYS))


@query("ffd_rolloff_85", SPEC + f""", c AS (SELECT *, sum(e) OVER (PARTITION BY part, channel ORDER BY k) AS cum, sum(e) OVER (PARTITION BY part, channel) AS tot FROM x)
SELECT part, channel, {R('arg_min(f, k) FILTER (cum >= 0.85::DOUBLE * tot)', 6)} AS rolloff_85 FROM c GROUP BY 1, 2""")
def _(t):
    return outputs(ff.rolloff(spectrum(t), KEYS))


def four(expr, name, digits=4):
    return ", ".join(f"{R(f'{fn}({expr})', digits, TIE_SQL)} AS {a}_{name}" for fn, a in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min")))


def gaps(expr="f - pf"):
    return ", ".join(f"{R(f'coalesce({fn}({expr}), 0)', 6, TIE_SQL)} AS {a}_peak_distance" for fn, a in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min")))


PEAKS = SPEC + """, w AS (SELECT *, lag(m) OVER z AS l, lead(m) OVER z AS r, sum(e) OVER (PARTITION BY part, channel) AS tot FROM x WINDOW z AS (PARTITION BY part, channel ORDER BY k)),
pk AS (SELECT *, lag(f) OVER (PARTITION BY part, channel ORDER BY k) AS pf, sum(e) OVER (PARTITION BY part, channel ORDER BY e DESC, k) AS cum FROM w WHERE l < m AND r < m),
g AS (SELECT DISTINCT part, channel, max(nb) OVER (PARTITION BY part, channel) AS nb FROM x)
"""


@query("ffd_spectral_peaks", PEAKS + f"""SELECT g.part, g.channel, count(pk.k) AS num_peaks, {four('m', 'peak_height')}, {four('f', 'peak_frequency', 6)}, {four('e', 'peak_energy', 4)},
 {four('e / tot', 'peak_energy_ratio', 6)}, count(*) FILTER (cum <= 0.95::DOUBLE * tot) AS num_significant_peaks, {gaps()}
FROM g LEFT JOIN pk ON g.part = pk.part AND g.channel = pk.channel GROUP BY 1, 2""")
def _(t):
    d = outputs(ff.peaks(kept_spectrum(t), KEYS), 4, nudge=TIE, **{f"{a}_{n}": x for a in ("mean", "std", "max", "min") for n, x in (
        ("peak_frequency", 6), ("peak_energy", 4), ("peak_energy_ratio", 6), ("peak_distance", 6))})
    return d


@query("ffd_power_spectral_density", PEAKS + f""", b AS (SELECT part, channel, {R('avg(e/nb)', 4, TIE_SQL)} AS mean_psd, {R('stddev_pop(e/nb)', 4, TIE_SQL)} AS std_psd, {R('max(e/nb)', 4, TIE_SQL)} AS max_psd, {R('min(e/nb)', 4, TIE_SQL)} AS min_psd,
 {R('CASE WHEN stddev_pop(e/nb) > 0 THEN (avg(power(e/nb,3)) - 3*avg(e/nb)*avg(power(e/nb,2)) + 2*power(avg(e/nb),3)) / power(var_pop(e/nb), 1.5) END', 3, TIE_SQL)} AS skewness_psd,
 {R('CASE WHEN stddev_pop(e/nb) > 0 THEN kurtosis_pop(e/nb) END', 3, TIE_SQL)} AS kurtosis_psd, {R('sum(f*e)/sum(e)', 6, TIE_SQL)} AS power_centroid_psd FROM x GROUP BY 1, 2),
q AS (SELECT part, channel, count(*) AS np, {four('e/nb', 'peak_value', 4)}, {four('f', 'peak_frequency', 6)}, {gaps()} FROM pk GROUP BY 1, 2)
SELECT b.*, coalesce(np, 0) AS num_peaks, q.* EXCLUDE (part, channel, np, mean_peak_distance, std_peak_distance, max_peak_distance, min_peak_distance),
 coalesce(mean_peak_distance, 0.0) AS mean_peak_distance, coalesce(std_peak_distance, 0) AS std_peak_distance, coalesce(max_peak_distance, 0) AS max_peak_distance,
 coalesce(min_peak_distance, 0) AS min_peak_distance FROM b LEFT JOIN q ON b.part = q.part AND b.channel = q.channel""")
def _(t):
    return outputs(ff.psd(kept_spectrum(t), KEYS), 4, nudge=TIE, skewness_psd=3, kurtosis_psd=3, power_centroid_psd=6, **{
        f"{a}_{n}": 6 for a in ("mean", "std", "max", "min") for n in ("peak_frequency", "peak_distance")})


@query("ffd_magnitude_stats", SPEC + f""", r AS (SELECT *, row_number() OVER (PARTITION BY part, channel ORDER BY m DESC, k) AS r FROM x)
SELECT part, channel, {R('avg(m)')} AS magnitude_mean, {R('stddev_pop(m)')} AS magnitude_std, {R('min(m)')} AS magnitude_min,
 {R('max(m) FILTER (r = 1)')} AS magnitude_1_max, {R('max(m) FILTER (r = 2)')} AS magnitude_2_max, {R('max(m) FILTER (r = 3)')} AS magnitude_3_max FROM r GROUP BY 1, 2""")
def _(t):
    return outputs(ff.magnitude_stats(spectrum(t), KEYS), 4)


_MOM = "sum(m*k)/sum(m) AS m1, sum(m*k*k)/sum(m) AS m2, sum(m*power(k,3))/sum(m) AS m3, sum(m*power(k,4))/sum(m) AS m4"


@query("ftd_fft_aggregated", SPEC + f""", g AS (SELECT part, channel, {_MOM} FROM x GROUP BY 1, 2), v AS (SELECT *, m2 - m1*m1 AS var FROM g)
SELECT part, channel, {R('m1')} AS fft_centroid, {R('var')} AS fft_variance,
 {R('CASE WHEN var >= 0.5 THEN (m3 - 3*m1*var - m1*m1*m1) / power(var, 1.5) END')} AS fft_skew,
 {R('CASE WHEN var >= 0.5 THEN (m4 - 4*m1*m3 + 6*m1*m1*m2 - 3*power(m1, 4)) / (var*var) END')} AS fft_kurtosis FROM v""")
def _(t):
    return outputs(ff.bin_moments(spectrum(t), KEYS), 4)


@query("ffd_feature_row")
def _(t):
    """Every time and frequency feature, one wide row per part: <feature>__<channel>."""
    keys = KEYS
    spec = materialise(spectrum(t), "spectrum")  # eight families read it
    rows = ft.time_features(t.series, keys, ORD, "v").join(ff.bin_moments(spec, keys), keys, "left").join(
        ff.freq_features(spec, keys), keys, "left")
    names = [c for c in rows.columns if c not in keys]
    packed = rows.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in names]).alias("r"))
    channels = ["click", "error", "purchase", "signup", "view"]
    wide = packed.groupBy("part").agg(*[F.first(F.when(F.col("channel") == c, F.col("r")), ignorenulls=True).alias(c) for c in channels])
    return wide.select("part", *[F.col(f"{c}.{n}").alias(f"{c}__{n}") for c in channels for n in names])


@query("sig_welch")
def _(t):
    """Averaged periodogram of each channel over all its events."""
    return outputs(sig.welch(t.series, ["channel"], ORD, "v", fs=1.0, nperseg=256))


@query("sig_stft_mean")
def _(t):
    return outputs(sig.stft_mean(t.series, ["channel"], ORD, "v"))


@query("sig_cwt_mean")
def _(t):
    return outputs(sig.cwt_mean(t.series, KEYS, ORD, "v"))


@query("sig_resample_512")
def _(t):
    d = sig.resampled(t.points, ["vec_id"], ["k"], "x", 512)
    return outputs(d.select("vec_id", F.posexplode(sig.baseline("x", 80)).alias("k", "x")))


@query("sig_baseline", """
WITH p AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, k, round(x - avg(x) FILTER (k < 8) OVER (PARTITION BY vec_id), 6) + 0.0 AS x FROM p""")
def _(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return outputs(e.select("vec_id", F.posexplode(sig.baseline("x", 8)).alias("k", "x")))


@query("fst_fft_bands", """
WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM p),
d AS (SELECT vec_id, k, sum(x * cos(2*pi()*((i*k)%64)/64))**2 + sum(x * sin(2*pi()*((i*k)%64)/64))**2 AS e FROM c, unnest(range(33)) u(k) GROUP BY 1, 2)
SELECT vec_id, round(sum(e), 5) AS energy_total, round(sum(e) FILTER (k >= 1 AND k < 5), 5) AS energy_low, round(sum(e) FILTER (k >= 5 AND k < 15), 5) AS energy_mid,
 round(sum(e) FILTER (k >= 15), 5) AS energy_high FROM d GROUP BY 1""")
def _(t):
    return outputs(st.fft_bands(t.points, ["vec_id"], "k", "x", 5, 15), 5)


@query("fw_dominant_freq", """
WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
d AS (SELECT vec_id, k, sum(x * cos(2*pi()*((i*k)%64)/64))**2 + sum(x * sin(2*pi()*((i*k)%64)/64))**2 AS e FROM p, unnest(range(32)) u(k) GROUP BY 1, 2)
SELECT vec_id, (arg_max(k, e))::INTEGER AS dominant FROM d GROUP BY 1""")
def _(t):
    return st.dominant_bin(t.points, ["vec_id"], "k", "x")


WINS = """WITH w AS (SELECT event_type AS channel, value AS v, event_id, ts, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) // 43200000000 AS window_id FROM events),
s AS (SELECT *, lag(v) OVER (PARTITION BY channel, window_id ORDER BY ts, event_id) AS p, avg(v) OVER g AS m, min(v) OVER g AS lo, max(v) OVER g AS hi FROM w WINDOW g AS (PARTITION BY channel, window_id)),
b AS (SELECT channel, window_id, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 5 END AS bin, count(*) AS c FROM s GROUP BY 1, 2, 3),
h AS (SELECT channel, window_id, -sum(c / t * ln(c / t)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY channel, window_id) AS t FROM b) GROUP BY 1, 2)
"""


@query("fw_window11", WINS + """SELECT s.channel, s.window_id::BIGINT AS window_id, round(avg(v) + 3e-8::DOUBLE, 5) AS mean, round(median(v) + 3e-8::DOUBLE, 5) AS median, round(var_pop(v) + 3e-8::DOUBLE, 4) AS variance,
 round(CASE WHEN var_pop(v) > 0 THEN avg(power(v-m,4))/power(avg(power(v-m,2)),2) - 3 END + 3e-8::DOUBLE, 4) + 0.0 AS kurtosis,
 round(CASE WHEN var_pop(v) > 0 THEN avg(power(v-m,3))/power(avg(power(v-m,2)),1.5) END + 3e-8::DOUBLE, 4) + 0.0 AS skewness, round(sqrt(avg(v*v)) + 3e-8::DOUBLE, 5) AS rms,
 count(*) FILTER (sign(v) <> sign(p)) AS zcr, round(max(entropy) + 3e-8::DOUBLE, 5) + 0.0 AS entropy FROM s JOIN h ON s.channel = h.channel AND s.window_id = h.window_id GROUP BY 1, 2""")
def _(t):
    w = st.relative_windows(t.series, ["channel"], "us", 43_200_000_000)
    d = st.window_stats(w, ["channel", "window_id"], ORD, "v")
    return outputs(d, 5, nudge=3e-8, variance=4, kurtosis=4, skewness=4)


@query("fw_window11_spectral")
def _(t):
    """Welch, short-time and wavelet means of the same windows."""
    w = st.relative_windows(t.series, ["channel"], "us", 43_200_000_000)
    return outputs(st.window_spectral(w, ["channel", "window_id"], ORD, "v", fs=1000.0))


@query("fw_select_relevant")
def _(t):
    """Window features in long form, imputed, ranked by their relevance for the label."""
    w = st.relative_windows(t.series, ["part"], "us", 432_000_000_000)
    w = w.withColumn("label", (F.col("v") > 25).cast("int"))
    return outputs(st.select_relevant(w, ["part", "window_id"], ORD, "v", "label", 4))
