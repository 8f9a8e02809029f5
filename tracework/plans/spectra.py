"""Simulation-field operators on the given tables (suppliers x quantities stand in for lines and bins)."""
from pyspark.sql import functions as F

from tracework.operators import signals as sig
from tracework.operators import spectra as sp
from tracework.operators.ordered import ordered_columns
from tracework.plans.registry import outputs, query

# --- cell lines: x = line number, y = supplier, z = quantity, time = shipping year --------------

CELLS = """c AS (SELECT year(l_shipdate) AS t, l_linenumber::DOUBLE AS x, l_suppkey * 0.5::DOUBLE AS y, l_quantity * 0.1::DOUBLE AS z,
 l_extendedprice AS vol, l_quantity + l_tax AS u, l_discount AS v FROM lineitem)"""


def cells(t):
    return t.lineitem.select(
        F.year("l_shipdate").alias("t"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_suppkey") * 0.5).alias("y"),
        (F.col("l_quantity") * 0.1).alias("z"), F.col("l_extendedprice").alias("vol"),
        (F.col("l_quantity") + F.col("l_tax")).alias("u"), F.col("l_discount").alias("v"))




def tol_sql(col):
    return f"(SELECT 0.25::DOUBLE * quantile_cont(g, 0.01) FROM (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT {col} AS x FROM c)) WHERE g > 0)"


@query("sig_levels_quantize", f"WITH {CELLS}, k AS (SELECT *, round_even(y / {tol_sql('y')}, 0)::BIGINT AS yq, round_even(x / {tol_sql('x')}, 0)::BIGINT AS xq FROM c) SELECT yq, xq, count(*) AS n FROM k GROUP BY 1, 2")
def _(t):
    c = cells(t)
    d = sp.quantize(c, "y", sp.level_tolerance(c, "y").scalar(), "yq")
    d = sp.quantize(d, "x", sp.level_tolerance(c, "x").scalar(), "xq")
    return d.groupBy("yq", "xq").agg(F.count(F.lit(1)).alias("n"))


LINES = f"""WITH {CELLS}, q AS (SELECT *, round_even(x / 0.25, 0)::BIGINT AS xq, round_even(y / 0.125, 0)::BIGINT AS yq, round_even(z / 0.5, 0)::BIGINT AS zq FROM c),
p AS (SELECT t, yq, zq, xq, avg(u) AS u, avg(v) AS v, sum(vol) AS w, sum(vol*y) AS wy, sum(vol*z) AS wz FROM q GROUP BY 1, 2, 3, 4),
g AS (SELECT t, yq, zq, count(*) AS planes, sum(wy)/sum(w) AS y_rep, sum(wz)/sum(w) AS z_rep, sum(w) AS w_rep, count(*) = (SELECT count(DISTINCT xq) FROM q) AS complete FROM p GROUP BY 1, 2, 3)
"""


def lines(t):
    return sp.cell_lines(cells(t), "x", "y", "z", "vol", "t", ["u", "v"], {"x": 0.25, "y": 0.125, "z": 0.5})


@query("sig_cell_lines", LINES + "SELECT t::INTEGER AS t, yq, zq, planes, round(y_rep, 6) AS y_rep, round(z_rep, 5) AS z_rep, round(w_rep, 2) AS w_rep, complete FROM g")
def _(t):
    d = lines(t).groupBy("t", "yq", "zq").agg(*[F.first(c).alias(c) for c in ("planes", "y_rep", "z_rep", "w_rep", "complete")])
    return outputs(d, 6, z_rep=5, w_rep=2)


PSD = LINES + """, o AS (SELECT p.*, row_number() OVER (PARTITION BY t, yq, zq ORDER BY xq) - 1 AS i FROM p JOIN g USING (t, yq, zq) WHERE complete),
m AS (SELECT *, u - avg(u) OVER (PARTITION BY t, yq, zq) AS uc, v - avg(v) OVER (PARTITION BY t, yq, zq) AS vc FROM o),
f AS (SELECT t, yq, zq, b, (CASE WHEN b IN (0, 3) THEN 1 ELSE 2 END) / 49.0::DOUBLE / 0.5 AS s,
 sum(uc*cos(2*pi()*i*b/7))**2 + sum(uc*sin(2*pi()*i*b/7))**2 AS eu, sum(vc*cos(2*pi()*i*b/7))**2 + sum(vc*sin(2*pi()*i*b/7))**2 AS ev FROM m, unnest(range(4)) r(b) GROUP BY 1, 2, 3, 4)
"""


@query("sig_line_psd", PSD + "SELECT t::INTEGER AS t, yq, zq, b::INTEGER AS b, round(eu * s, 6) + 0.0 AS phi_u, round(ev * s, 8) + 0.0 AS phi_v FROM f")
def _(t):
    full = lines(t).where("complete")
    p = sig.line_psd(full.select("t", "yq", "zq", "plane", "u", "v"), ["t", "yq", "zq"], ["plane"], ["u", "v"], 0.5)
    return outputs(p, 6, phi_v=8)


@query("sig_parseval")
def _(t):
    """Variance of 8x8 blocks of the vectors before and after the transform (even length: exact)."""
    pts = t.points
    spec = sig.line_psd(pts.select("vec_id", "k", "x"), ["vec_id"], ["k"], ["x"], 0.5)
    return sp.parseval(pts, spec, ["vec_id"], "x", "phi_x", 0.5)


@query("sig_line_spectrum", """
WITH p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2*pi()*i/64)) AS x FROM p),
d AS (SELECT vec_id, b, sum(x * cos(2*pi()*((i*b)%64)/64))**2 + sum(x * sin(2*pi()*((i*b)%64)/64))**2 AS e FROM c, unnest(range(1, 33)) u(b) GROUP BY 1, 2)
SELECT vec_id, round(2*pi()*b/(64*0.01::DOUBLE), 6) AS k, round(0.01::DOUBLE/(64*0.375::DOUBLE) * e * (CASE WHEN b < 32 THEN 2 ELSE 1 END), 8) AS e FROM d""")
def _(t):
    return outputs(sig.line_spectrum(t.points, ["vec_id"], ["k"], "x", 0.01), 6, e=8)


# --- spectra grid: bin = supplier, k = quantity ----------------------------------------------

GRID = """g AS (SELECT l_suppkey AS bin, l_suppkey * 2.0::DOUBLE + 5 AS d, l_quantity AS k, avg(l_extendedprice) AS pu, avg(l_discount) AS pv, avg(l_tax) AS pw, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL)"""


def grid(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("bin"), F.col("l_quantity").alias("k")).agg(
        F.avg("l_extendedprice").alias("pu"), F.avg("l_discount").alias("pv"), F.avg("l_tax").alias("pw"),
        F.sum("l_extendedprice").alias("w")).withColumn("d", F.col("bin") * 2.0 + 5)


@query("sig_premultiplied", f"""WITH {GRID} SELECT bin, k, round(k/0.25*pu, 3) AS pre_pu, round(k/0.25*pv, 6) AS pre_pv, round(k/0.25*pw, 6) AS pre_pw,
 round(k/0.25*(pu+pv+pw), 3) AS pre_total, round(pu/(pu+pv+pw), 9) AS share_pu, round(pv/(pu+pv+pw), 9) AS share_pv, round(pw/(pu+pv+pw), 9) AS share_pw FROM g""")
def _(t):
    d = sp.premultiplied(grid(t), "k", ["pu", "pv", "pw"], 0.5).drop("pu", "pv", "pw", "w", "d")
    return outputs(d, 6, pre_pu=3, pre_total=3, share_pu=9, share_pv=9, share_pw=9)


@query("sig_anisotropy", f"""WITH {GRID}, m AS (SELECT max(pv) AS mv, max(pw) AS mw FROM g)
SELECT bin, k, round(CASE WHEN pv > greatest(1e-30, 1e-6*mv) AND pw > greatest(1e-30, 1e-6*mw) THEN log10(pv/pw) END, 6) + 0.0 AS log_ratio FROM g, m""")
def _(t):
    return outputs(sp.anisotropy(grid(t), "pv", "pw").select("bin", "k", "log_ratio"))


_CURVE = f"WITH {GRID}, c AS (SELECT k, sum(pu*w)/sum(w) AS phi FROM g WHERE d BETWEEN 90 AND 170 AND w > 0 GROUP BY 1) "


@query("sig_inertial_slope", _CURVE + """SELECT count(*) AS points, round(CASE WHEN count(*) >= 6 THEN regr_slope(log10(phi), log10(k)) END, 6) AS slope,
 round(CASE WHEN count(*) >= 6 THEN regr_slope(log10(phi), log10(k)) END + 5.0/3.0::DOUBLE, 6) AS delta FROM c WHERE k BETWEEN 8 AND 25 AND phi > 0""")
def _(t):
    return outputs(sp.inertial_slope(grid(t), [], "k", "pu", "w", "d", (90, 170), (8, 25)))


@query("sig_compensated", f"WITH {GRID} SELECT bin, k, round(power(k, 5.0/3.0::DOUBLE) * pw, 5) AS compensated FROM g")
def _(t):
    return outputs(grid(t).select("bin", "k", (F.pow("k", F.lit(5.0 / 3.0)) * F.col("pw")).alias("compensated")), 5)


_BOX = f"WITH {GRID}, x AS (SELECT * FROM g WHERE k BETWEEN 20 AND 50 AND d BETWEEN 8 AND 130), v AS (SELECT k, avg(pw) AS m, median(pw) AS md FROM x GROUP BY 1)"


@query("sig_tail_box", _BOX + """, l AS (SELECT *, m - lag(m) OVER (ORDER BY k) AS s FROM v WHERE k >= 30), p AS (SELECT max(m) AS pk FROM (SELECT avg(pw) AS m FROM g WHERE d BETWEEN 8 AND 130 GROUP BY k))
SELECT round(avg(m), 6) AS tail_mean, round(arg_max(m, k), 6) AS tail_last, round(avg(CASE WHEN s <= 0 THEN 1.0::DOUBLE WHEN s > 0 THEN 0.0::DOUBLE END), 6) AS frac_nonincreasing,
 round(avg(m) / max(pk), 6) AS r_tail, CASE WHEN avg(m)/max(pk) < 0.05 THEN 'very small' WHEN avg(m)/max(pk) < 0.15 THEN 'reduced' ELSE 'elevated' END AS verdict FROM l, p""")
def _(t):
    return outputs(sp.tail_box(grid(t), "k", "d", "pw", (20, 50), (8, 130), 30)[1])


@query("sig_tail_curve", _BOX + " SELECT k, round(m, 6) AS mean_curve, round(md, 6) AS median_curve FROM v")
def _(t):
    return outputs(sp.tail_box(grid(t), "k", "d", "pw", (20, 50), (8, 130), 30)[0])


@query("sig_curve_pick", f"""WITH {GRID}, b AS (SELECT DISTINCT bin, d FROM g), r AS (SELECT unnest([5.0, 30.0, 101.5, 150.0])::DOUBLE AS requested)
SELECT requested, arg_min(d, (abs(d - requested), d)) AS d, arg_min(bin, (abs(d - requested), d)) AS bin FROM b, r GROUP BY 1""")
def _(t):
    return sp.nearest_pick(grid(t).select("bin", "d").distinct(), "d", [5.0, 30.0, 101.5, 150.0], "bin")


@query("sig_color_limits", f"WITH {GRID} SELECT round(quantile_cont(log10(pw), 0.05), 6) AS low, round(quantile_cont(log10(pw), 0.95), 6) AS high FROM g WHERE pw > 0")
def _(t):
    return outputs(sp.log_limits(grid(t), "pw", 0.05, 0.95))


# --- interpolation and profiles ---------------------------------------------------------------

_INTERP = """ s AS (SELECT *, lead(x) OVER (PARTITION BY key ORDER BY x) AS x1, lead(y) OVER (PARTITION BY key ORDER BY x) AS y1 FROM cv),
 sg AS (SELECT * FROM s WHERE x1 IS NOT NULL), fs AS (SELECT key, min(x) AS fx FROM sg GROUP BY 1),
 jn AS (SELECT gr.key, gr.gx, sg.x, sg.y, sg.x1, sg.y1 FROM (SELECT gr0.key, gr0.gx, greatest(gx, fx) AS jx FROM gr0 JOIN fs ON fs.key = gr0.key) gr ASOF JOIN sg ON gr.key = sg.key AND gr.jx >= sg.x)"""


@query("sig_common_grid", f"""WITH cv AS (SELECT l_returnflag AS key, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
 lim AS (SELECT max(a) AS lo, min(b) AS hi FROM (SELECT key, min(x) AS a, max(x) AS b FROM cv GROUP BY 1)),
 gr0 AS (SELECT key, power(10.0::DOUBLE, log10(lo) + i * ((log10(hi) - log10(lo)) / 299)) AS gx FROM (SELECT DISTINCT key FROM cv), lim, unnest(range(300)) u(i)),
{_INTERP} SELECT round(gx, 6) AS k, round(avg(y + (y1 - y) / (x1 - x) * (gx - x)), 3) AS e FROM jn GROUP BY gx""")
def _(t):
    cv = t.lineitem.groupBy("l_returnflag", F.col("l_quantity").alias("k")).agg(F.avg("l_extendedprice").alias("e"))
    return outputs(sp.common_grid_mean(cv, "l_returnflag", "k", "e", 300), 6, e=3)


@query("sig_interp_profile", f"""WITH cv AS (SELECT l_suppkey AS key, l_extendedprice AS x, avg(l_tax) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
 gr0 AS (SELECT DISTINCT l_suppkey AS key, l_extendedprice AS gx FROM lineitem WHERE l_linestatus = 'O'),
{_INTERP} SELECT key AS l_suppkey, gx AS x, round(y + (y1 - y) / (x1 - x) * (gx - x), 5) + 0.0 AS y FROM jn""")
def _(t):
    d = t.lineitem.select("l_suppkey", F.col("l_extendedprice").alias("x"), F.col("l_tax").alias("y"), "l_linestatus")
    a = d.where("l_linestatus = 'O'").select("l_suppkey", "x").distinct()
    b = d.where("l_linestatus = 'F'").groupBy("l_suppkey", "x").agg(F.avg("y").alias("y"))
    return outputs(sp.interpolate(b, a, ["l_suppkey"], "x", "y"), 5)


@query("sig_loglaw_fit")
def _(t):
    """Profile of the cumulative number of orders over key position, in log-law form."""
    y = F.floor(F.col("o_orderkey") / 15.0).cast("double")
    prof = t.orders.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    prof = ordered_columns(prof, [], ["y"], running={"total": "n"}).where("y > 0")
    return outputs(sp.loglaw_fit(prof.select("y", (F.ln("total") / 0.41).alias("u")), "y", "u"))


@query("sig_time_pick", """SELECT requested, arg_min(ms, (abs(ms - requested), ms)) AS ms, arg_min(event_id, (abs(ms - requested), ms)) AS event_id
FROM (SELECT event_id, (epoch_us(ts) // 1000)::DOUBLE AS ms FROM events), (SELECT unnest([1704100000000, 1705000000000])::DOUBLE AS requested) GROUP BY 1""")
def _(t):
    d = t.series.select(F.floor(F.col("us") / 1000).cast("double").alias("ms"), "event_id")
    return sp.nearest_pick(d, "ms", [1704100000000.0, 1705000000000.0], "event_id")


@query("sig_time_steps", """SELECT event_type AS channel, min(s)::BIGINT AS min_step, max(s)::BIGINT AS max_step, round(avg(s), 2) AS mean_step
FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM events) GROUP BY 1""")
def _(t):
    return outputs(sp.time_steps(t.series, ["channel"], "us"), 2)
