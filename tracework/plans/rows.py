"""Projections, gates and quality rules on the given tables."""
from pyspark.sql import functions as F

from tracework.functions.numeric import norm
from tracework.operators import quality as q
from tracework.plans.registry import outputs, query

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("prj_vector_norm", f"""
SELECT {LINE_SQL}, round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax), 6) AS total
FROM lineitem""")
def _(t):
    return outputs(t.lineitem.select(*LINE, norm("l_quantity", "l_discount", "l_tax").alias("total")))


@query("flt_depth_gate", f"""
SELECT {LINE_SQL}, l_quantity FROM lineitem
WHERE l_quantity >= 0.975 * (SELECT max(l_quantity) FROM lineitem)""")
def _(t):
    return q.depth_gate(t.lineitem.select(*LINE, "l_quantity"), "l_quantity", 0.975)


@query("flt_depth_gate_strict", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)""")
def _(t):
    return q.depth_gate(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 1.0)


@query("flt_fixed_gate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 42062")
def _(t):
    return q.fixed_gate(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")


_GAPS = """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  WHEN event_type = 'signup' THEN 'Infinity'::DOUBLE ELSE value END AS v FROM events"""


def _with_gaps(t):
    v = F.when(F.col("event_type") == "error", None).when(
        F.col("event_type") == "signup", F.lit(float("inf"))
    ).otherwise(F.col("value"))
    return t.events.select("event_id", v.cast("double").alias("v"))


@query("flt_finite", f"SELECT event_id, v FROM ({_GAPS}) WHERE v IS NOT NULL AND v < 'Infinity'::DOUBLE")
def _(t):
    return q.drop_non_finite(_with_gaps(t), ["v"])


@query("flt_finite_fill", f"""SELECT event_id,
CASE WHEN v IS NULL OR v = 'Infinity'::DOUBLE THEN 0.0::DOUBLE ELSE v END AS v FROM ({_GAPS})""")
def _(t):
    return q.fill_non_finite(_with_gaps(t), ["v"])


@query("prj_elapsed", """
SELECT event_id, user_id AS part,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::BIGINT AS elapsed
FROM events""")
def _(t):
    return q.elapsed(t.series, ["part"], "us").select("event_id", "part", "elapsed")


@query("prj_epoch_ms", """
SELECT event_id, epoch_us(ts) // 1000 AS ms, year(ts)::INTEGER AS y, hour(ts)::INTEGER AS h FROM events""")
def _(t):
    ms = t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    back = F.timestamp_millis("ms")
    return ms.select("event_id", "ms", F.year(back).alias("y"), F.hour(back).alias("h"))


@query("flt_quality_rules", """
WITH g AS (SELECT l_suppkey, count(*) AS raw_length,
  greatest(max(l_quantity)-min(l_quantity), max(l_extendedprice)-min(l_extendedprice),
           max(l_discount)-min(l_discount)) AS span,
  max(greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount))) AS peak
  FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey, raw_length, concat_ws(';',
  CASE WHEN raw_length < 580 THEN 'too_short' END, CASE WHEN raw_length > 620 THEN 'too_long' END,
  CASE WHEN span < 1e-6 THEN 'all_channels_flat' END,
  CASE WHEN peak > 104500 THEN 'unrealistic_amplitude' END) AS reason FROM g)
SELECT l_suppkey, raw_length, reason = '' AS valid,
  CASE WHEN reason = '' THEN 'valid' ELSE reason END AS quality_reason FROM r""")
def _(t):
    return q.quality_rules(t.lineitem, ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"],
                           min_len=580, max_len=620, amplitude=104500)


@query("prj_split_state", """
SELECT doc_id, toxic, 'positive' AS frame FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, toxic, 'negative' FROM labels WHERE quality = 0""")
def _(t):
    pos = t.labels.where("quality = 1").select("doc_id", "toxic", F.lit("positive").alias("frame"))
    neg = t.labels.where("quality = 0").select("doc_id", "toxic", F.lit("negative").alias("frame"))
    return pos.unionByName(neg)


@query("prj_clip_sample", """
SELECT event_id, event_type FROM events ORDER BY md5(event_id::VARCHAR || ':42'), event_id LIMIT 5""")
def _(t):
    return q.sample_rows(t.events.select("event_id", "event_type"), "event_id", 5)


@query("prj_shuffle", """
SELECT event_id, md5(event_id::VARCHAR || ':42') AS shuffle_key FROM events""")
def _(t):
    return q.shuffle_rows(t.events.select("event_id"), "event_id")


@query("prj_wall_units", """
SELECT o_orderkey, round(y_plus, 6) AS y_plus, round(u_plus, 6) AS u_plus FROM (
  SELECT o_orderkey, 0.05 * (o_totalprice - 1000.0) / 15.0 AS y_plus, o_custkey / 0.05 AS u_plus FROM orders)
WHERE y_plus > 0 AND y_plus <= 1000""")
def _(t):
    d = q.wall_units(t.orders, "o_totalprice", "o_custkey", 0.05, 15.0, 1000.0, 1000.0)
    return outputs(d.select("o_orderkey", "y_plus", "u_plus").orderBy("y_plus"))


@query("prj_friction_velocity", f"""
SELECT {LINE_SQL}, round(sqrt(abs(sqrt(l_quantity*l_quantity + l_tax*l_tax + l_discount*l_discount)) / 1.225::DOUBLE), 6) AS u_tau
FROM lineitem""")
def _(t):
    tau = norm("l_quantity", "l_tax", "l_discount")
    return outputs(t.lineitem.select(*LINE, q.friction_velocity(tau).alias("u_tau")))


_BUDGET_SQL = f"""SELECT {LINE_SQL}, l_discount AS g11, l_tax AS g12, l_discount - l_tax AS g13, l_tax - 0.02::DOUBLE AS g21,
 l_discount * 2 AS g22, l_tax * 3 AS g23, 0.01::DOUBLE AS g31, l_discount - 0.03::DOUBLE AS g32, l_tax * l_discount AS g33,
 l_quantity AS r11, l_quantity * 0.1::DOUBLE AS r12, l_quantity * l_tax AS r13, l_quantity * 0.5::DOUBLE AS r22,
 l_quantity * l_discount AS r23, l_quantity * 0.25::DOUBLE AS r33 FROM lineitem"""


def _budget_input(t):
    d, x, n = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return t.lineitem.select(
        *LINE, d.alias("g11"), x.alias("g12"), (d - x).alias("g13"), (x - 0.02).alias("g21"),
        (d * 2).alias("g22"), (x * 3).alias("g23"), F.lit(0.01).alias("g31"), (d - 0.03).alias("g32"),
        (x * d).alias("g33"), n.alias("r11"), (n * 0.1).alias("r12"), (n * x).alias("r13"),
        (n * 0.5).alias("r22"), (n * d).alias("r23"), (n * 0.25).alias("r33"),
    )


@query("prj_tke_budget", f"""
WITH b AS ({_BUDGET_SQL}),
p AS (SELECT *, r11 + r22 AS k_total, g11 + g12 AS eps_total,
 -(g11*r11 + g12*r12 + g13*r13 + g21*r12 + g22*r22 + g23*r23 + g31*r13 + g32*r23 + g33*r33) AS production FROM b)
SELECT {LINE_SQL}, round(k_total, 6) AS k_total, round(eps_total, 6) AS eps_total,
 round(production, 6) + 0.0 AS production, round(-g11*r11, 6) + 0.0 AS p11, round(-g22*r22, 6) + 0.0 AS p22,
 round(-g33*r33, 6) + 0.0 AS p33, round(-g12*r12, 6) + 0.0 AS p12,
 round(production * eps_total, 6) + 0.0 AS prod_times_eps,
 round(CASE WHEN eps_total <> 0 THEN production / eps_total END, 6) + 0.0 AS prod_over_eps FROM p""")
def _(t):
    grad = {f"{i}{j}": f"g{i}{j}" for i in "123" for j in "123"}
    stress = {ij: f"r{ij}" for ij in ("11", "12", "13", "22", "23", "33")}
    d = q.tke_budget(_budget_input(t), grad, stress, "r11", "r22", "g11", "g12")
    return outputs(d.select(*LINE, "k_total", "eps_total", "production", "p11", "p22", "p33", "p12",
                            "prod_times_eps", "prod_over_eps"))


@query("prj_turb_intensity", f"""
SELECT {LINE_SQL}, round(l_quantity / (0.05::DOUBLE*0.05::DOUBLE), 6) AS uu_plus, round(sqrt(l_quantity), 6) AS uu_rms,
 round(l_tax / (0.05::DOUBLE*0.05::DOUBLE), 6) AS vv_plus, round(sqrt(l_tax), 6) AS vv_rms FROM lineitem""")
def _(t):
    d = t.lineitem.select(*LINE, F.col("l_quantity").alias("uu"), F.col("l_tax").alias("vv"))
    return outputs(q.turbulence_intensity(d, ["uu", "vv"], 0.05).drop("uu", "vv"))


@query("prj_resolved_k", f"""
SELECT {LINE_SQL}, round(0.5 * (l_quantity + l_discount + l_tax) + l_extendedprice, 6) AS k FROM lineitem""")
def _(t):
    k = q.resolved_k(["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return outputs(t.lineitem.select(*LINE, k.alias("k")))


@query("prj_wall_distance", f"""
WITH e AS (SELECT min(l_quantity) y0, max(l_quantity) y1, min(l_discount) z0, max(l_discount) z1 FROM lineitem)
SELECT {LINE_SQL}, round(least(l_quantity - y0, y1 - l_quantity), 6) AS dy,
 round(least(l_discount - z0, z1 - l_discount), 6) AS dz,
 round(least(l_quantity - y0, y1 - l_quantity, l_discount - z0, z1 - l_discount), 6) AS d,
 round(least(l_quantity - y0, y1 - l_quantity, l_discount - z0, z1 - l_discount) * (0.5::DOUBLE/0.001::DOUBLE), 6) AS d_plus
FROM lineitem, e""")
def _(t):
    d = q.wall_distance(t.lineitem.select(*LINE, "l_quantity", "l_discount"), "l_quantity", "l_discount", 0.5, 0.001)
    return outputs(d.drop("l_quantity", "l_discount"))
