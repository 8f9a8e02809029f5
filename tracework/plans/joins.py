"""Join operators on the given tables."""
from pyspark.sql import functions as F

from tracework.functions.numeric import log_bin
from tracework.operators import aggregates as a
from tracework.operators import joins as j
from tracework.operators import quality as q
from tracework.operators import windows as win
from tracework.plans.registry import outputs, query

_SIDES = """
l AS (SELECT user_id AS part, event_id, epoch_us(ts) AS us, value AS v FROM events WHERE event_type = 'click'),
r AS (SELECT user_id AS part, event_id, epoch_us(ts) AS us, value AS v FROM events WHERE event_type = 'view')"""
_BOTH = f"""
WITH {_SIDES},
b AS (SELECT l.*, r.event_id AS b_id, r.us AS b_us, r.v AS b_v FROM l ASOF LEFT JOIN r ON l.part = r.part AND l.us >= r.us),
f AS (SELECT l.event_id AS l_id, r.event_id AS f_id, r.us AS f_us, r.v AS f_v FROM l ASOF LEFT JOIN r ON l.part = r.part AND l.us <= r.us),
m AS (SELECT b.*, f.*, CASE WHEN f_id IS NULL THEN true WHEN b_id IS NULL THEN false ELSE us - b_us <= f_us - us END AS back
      FROM b JOIN f ON b.event_id = f.l_id)"""


def _sides(t):
    s = t.series
    left = s.where("channel = 'click'").drop("channel")
    right = s.where("channel = 'view'").select(
        "part", "us", F.col("event_id").alias("r_id"), F.col("v").alias("r_v")
    )
    return left, right


def _asof(t, direction):
    left, right = _sides(t)
    return j.asof_join(left, right, "us", ["part"], direction, "event_id", "r_id").drop("us", "us_right")


@query("join_asof_nearest", _BOTH + """
SELECT part, event_id, v, CASE WHEN back THEN b_id ELSE f_id END AS r_id, CASE WHEN back THEN b_v ELSE f_v END AS r_v FROM m""")
def _(t):
    return _asof(t, "nearest")


@query("join_asof_backward", _BOTH + "SELECT part, event_id, v, b_id AS r_id, b_v AS r_v FROM m")
def _(t):
    return _asof(t, "backward")


@query("join_asof_forward", _BOTH + "SELECT part, event_id, v, f_id AS r_id, f_v AS r_v FROM m")
def _(t):
    return _asof(t, "forward")


@query("join_asof_backward_forward", _BOTH + "SELECT part, event_id, b_id, f_id FROM m")
def _(t):
    """Both one-sided matches of every click, from one pass."""
    return _asof(t, "both").select("part", "event_id", F.col("r_id").alias("b_id"), F.col("r_id_ahead").alias("f_id"))


@query("join_asof_unkeyed", f"""
WITH {_SIDES},
b AS (SELECT l.*, r.event_id AS b_id, r.us AS b_us FROM l ASOF LEFT JOIN r ON l.us >= r.us),
f AS (SELECT l.event_id AS l_id, r.event_id AS f_id, r.us AS f_us FROM l ASOF LEFT JOIN r ON l.us <= r.us)
SELECT b.part, b.event_id, CASE WHEN f_id IS NULL THEN b_id WHEN b_id IS NULL THEN f_id
  WHEN us - b_us <= f_us - us THEN b_id ELSE f_id END AS r_id
FROM b JOIN f ON b.event_id = f.l_id""")
def _(t):
    left, right = _sides(t)
    got = j.asof_join(left, right.drop("part"), "us", [], "nearest", "event_id", "r_id")
    return got.select("part", "event_id", "r_id")


_TOOL = _BOTH + """,
g AS (SELECT part, event_id, us, v, CASE WHEN back THEN b_v ELSE f_v END AS z FROM m),
k AS (SELECT * FROM g WHERE z >= 0.1::DOUBLE * (SELECT max(z) FROM g)),
i AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM k),
w AS (SELECT *, i // 3 AS window_id, (v > z)::INTEGER AS label FROM i WHERE i < (n // 3) * 3)"""


@query("tool_wear_windows", _TOOL + """
SELECT part, window_id, count(*) AS n, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std,
 round(sum(v), 6) AS v_sum, round(median(v), 6) AS v_median, round(avg(z), 6) AS z_mean, round(stddev_samp(z), 6) AS z_std,
 round(sum(z), 6) AS z_sum, round(median(z), 6) AS z_median,
 (CASE WHEN 2 * sum(label) > count(*) THEN 1 ELSE 0 END)::INTEGER AS label
FROM w GROUP BY 1, 2""")
def _(t):
    """Nearest join -> depth gate -> count windows -> four statistics per axis -> majority label."""
    left, right = _sides(t)
    near = j.asof_join(left, right.withColumnRenamed("r_v", "z"), "us", ["part"], "nearest",
                       "event_id", "r_id")
    gated = q.depth_gate(near, "z", 0.1)
    w = win.count_windows(gated.withColumn("label", (F.col("v") > F.col("z")).cast("int")),
                          ["part"], ["us", "event_id"], 3)
    return outputs(a.window12(w, ["part", "window_id"], ["v", "z"], "label"))


@query("join_full_outer_features", """
SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, max(user_id) AS label,
 """ + ",\n ".join(
    f"round(coalesce(avg(value) FILTER (event_type = '{c}'), 0), 6) AS {c}_mean, "
    f"round(coalesce(stddev_pop(value) FILTER (event_type = '{c}'), 0), 6) AS {c}_std"
    for c in ("click", "error", "purchase", "signup", "view")) + """
FROM events GROUP BY 1""")
def _(t):
    hour = F.unix_millis(F.date_trunc("hour", F.timestamp_micros("us")))
    s = t.series.withColumn("start_ms", hour)
    wide = j.pivot_features(s, ["start_ms"], "channel", ["click", "error", "purchase", "signup", "view"],
                            {"mean": F.avg("v"), "std": F.stddev_pop("v")}, 0.0)
    label = s.groupBy("start_ms").agg(F.max("part").alias("label"))
    return outputs(wide.join(label, "start_ms", "full_outer"))


@query("join_label_inner", """
SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


CHANNELS = ("click", "error", "purchase", "signup", "view")


@query("join_horizontal", "SELECT user_id AS part, " + ", ".join(
    f"round(avg(value) FILTER (event_type = '{c}'), 6) AS {c}_mean, max(value) FILTER (event_type = '{c}') AS {c}_max" for c in CHANNELS) + " FROM events GROUP BY 1")
def _(t):
    """Feature frames of all channels side by side."""
    return outputs(j.pivot_features(t.series, ["part"], "channel", CHANNELS, {"mean": F.avg("v"), "max": F.max("v")}))


_ALIGN_SQL = """
f AS (SELECT CASE WHEN label = 0 THEN 'new' ELSE 'wear' END AS state, vec_id AS id, embedding[1]::DOUBLE AS s FROM embeddings),
p AS (SELECT CASE WHEN quality = 0 THEN 'new' ELSE 'wear' END AS state, doc_id AS id, (toxic + doc_id)::DOUBLE AS s FROM labels),
h AS (SELECT CASE WHEN p_size <= 5 THEN 'new' ELSE 'wear' END AS state, p_partkey AS id, p_retailprice AS s FROM part),
a AS (SELECT f.state, f.pair, f.s AS force, p.s AS punch, h.s AS sheet FROM
 (SELECT *, row_number() OVER (PARTITION BY state ORDER BY id) - 1 AS pair FROM f) f
 JOIN (SELECT *, row_number() OVER (PARTITION BY state ORDER BY id) - 1 AS pair FROM p) p ON f.state = p.state AND f.pair = p.pair
 JOIN (SELECT *, row_number() OVER (PARTITION BY state ORDER BY id) - 1 AS pair FROM h) h ON f.state = h.state AND f.pair = h.pair)"""


def aligned_scores(t):
    tag = lambda c: F.when(c, "new").otherwise("wear").alias("state")
    force = t.embeddings.select(tag(F.col("label") == 0), F.col("vec_id").alias("id"),
                                F.element_at("embedding", 1).cast("double").alias("s"))
    punch = t.labels.select(tag(F.col("quality") == 0), F.col("doc_id").alias("id"),
                            (F.col("toxic") + F.col("doc_id")).cast("double").alias("s"))
    sheet = t.part.select(tag(F.col("p_size") <= 5), F.col("p_partkey").alias("id"),
                          F.col("p_retailprice").alias("s"))
    return j.index_aligned({"force": force, "punch": punch, "sheet": sheet}, "state", "id", "s")


@query("join_index_aligned", f"WITH {_ALIGN_SQL} SELECT state, pair, round(force, 6) AS force, punch, sheet FROM a")
def _(t):
    return outputs(aligned_scores(t))


@query("join_semi_row_overlap", """
SELECT doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)
AND EXISTS (SELECT 1 FROM documents e WHERE e.doc_id NOT IN (SELECT doc_id FROM labels)
            AND e.text = d.text AND e.lang = d.lang)""")
def _(t):
    train = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    test = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return j.row_overlap(train, test, ["text", "lang"]).select("doc_id")


@query("join_related_items", """
WITH m AS (SELECT p_brand, arg_max(p_name, (p_retailprice, p_partkey)) AS p_name FROM part GROUP BY 1)
SELECT p_partkey, p_brand, p_name FROM part p WHERE EXISTS
 (SELECT 1 FROM m WHERE m.p_brand = p.p_brand AND m.p_name = p.p_name)""")
def _(t):
    items = t.part.select("p_partkey", "p_brand", "p_name", "p_retailprice")
    matched = items.groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("p_name"))
    return j.related_items(items, matched, ["p_brand", "p_name"]).drop("p_retailprice")


@query("join_broadcast_scalar", """
WITH s AS (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s, avg(l_tax) mt, stddev_pop(l_tax) st FROM lineitem WHERE l_returnflag = 'N')
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity - m) / greatest(s, 1e-12), 6) AS l_quantity_z,
 round((l_tax - mt) / greatest(st, 1e-12), 6) AS l_tax_z FROM lineitem, s""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    z = j.apply_reference_scale(d, d.where("l_returnflag = 'N'"), ["l_quantity", "l_tax"])
    return outputs(z.drop("l_quantity", "l_tax", "l_returnflag"))


@query("join_band_bins", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 5000 AND o_totalprice < 400000 THEN
 least(floor((ln(o_totalprice) - ln(5000)) / ((ln(400000) - ln(5000)) / 35)), 34)::INTEGER END AS bin FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", log_bin("o_totalprice", 5000.0, 400000.0, 35).alias("bin"))
