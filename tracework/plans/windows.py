"""Windows, segmentation and ranking on the given tables."""
from pyspark.sql import functions as F

from tracework.operators import peaks as pk
from tracework.operators import strokes as st
from tracework.operators import windows as win
from tracework.operators.ordered import group_mode, ordered_columns
from tracework.plans.registry import outputs, query

ORD = ["us", "event_id"]
_IDX = """i AS (SELECT user_id AS part, event_id, event_type, value AS v, epoch_us(ts) AS us,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query("win_count_fixed_num", f"""
WITH {_IDX} SELECT part, event_id, i // (n // 7) AS window_id FROM i WHERE i < n - n % (n // 7)""")
def _(t):
    return win.fixed_number_windows(t.series, ["part"], ORD, 7).select("part", "event_id", "window_id")


@query("win_count_size", f"""
WITH {_IDX} SELECT part, event_id, i // 50 AS window_id FROM i WHERE i < n - n % 50""")
def _(t):
    return win.count_windows(t.series, ["part"], ORD, 50).select("part", "event_id", "window_id")


@query("win_time_tumbling", """
WITH w AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 21600000000 AS window_id FROM events)
SELECT user_id AS part, window_id::BIGINT AS window_id, arg_min(event_type, ts) AS label, count(*) AS n, round(avg(value), 6) AS v_mean FROM w GROUP BY 1, 2""")
def _(t):
    w = win.tumbling(t.series, ["part"], "us", 21_600_000_000)
    return outputs(w.groupBy("part", "window_id").agg(
        F.min_by("channel", "us").alias("label"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("v_mean")))


@query("win_gap_session", """
WITH l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id AS part, event_id, (sum(CASE WHEN d > 28800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM l""")
def _(t):
    return win.gap_sessions(t.series, ["part"], ORD, 28_800_000_000).select("part", "event_id", "session")


_SEG = f"""{_IDX},
h AS (SELECT *, (max(v) OVER (PARTITION BY part) + min(v) OVER (PARTITION BY part)) * 0.5::DOUBLE AS thr,
 lead(v) OVER (PARTITION BY part ORDER BY i) AS nx FROM i),
e AS (SELECT *, CASE WHEN v <= thr AND nx > thr THEN 1 ELSE 0 END AS edge FROM h),
s AS (SELECT *, sum(edge) OVER (PARTITION BY part ORDER BY i) AS seg, sum(edge) OVER (PARTITION BY part) AS edges FROM e),
g AS (SELECT part, i, event_id, v, (seg - 1)::BIGINT AS segment FROM s WHERE seg >= 1 AND seg < edges)"""


def segments(t):
    return win.rising_edge_segments(t.series, ["part"], ORD, "v")


@query("seg_rising_edge", f"WITH {_SEG} SELECT part, segment, min(i) AS raw_start, max(i) + 1 AS raw_end, count(*) AS raw_length FROM g GROUP BY 1, 2")
def _(t):
    return segments(t).groupBy("part", "segment").agg(
        F.min("i").alias("raw_start"), (F.max("i") + 1).alias("raw_end"), F.count(F.lit(1)).alias("raw_length"))


@query("seg_min_length", f"WITH {_SEG} SELECT part, segment, event_id FROM g QUALIFY count(*) OVER (PARTITION BY part, segment) >= 8")
def _(t):
    return win.min_length(segments(t), ["part", "segment"], 8).select("part", "segment", "event_id")


@query("win_margin_slice", f"""WITH {_SEG},
b AS (SELECT part, min(i) AS s, max(i) + 1 AS e FROM g WHERE segment = 1 GROUP BY 1)
SELECT i.part, i.event_id, i.i FROM i JOIN b ON i.part = b.part WHERE i.i >= s - 3 AND i.i < e + 3""")
def _(t):
    raw = ordered_columns(t.series, ["part"], ORD, index="i")
    b = segments(t).where("segment = 1").groupBy("part").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return win.margin_slice(raw, b, ["part"], "i", 3).select("part", "event_id", "i")


@query("seg_peak_fallback")
def _(t):
    """Strokes between prominent peaks for parts whose trigger gives fewer than six segments."""
    signal = ordered_columns(t.series, ["part"], ORD, index="i").select("part", "i", "v")
    weak = pk.weak_recordings(signal, segments(t), ["part"], 6)
    return pk.segments_between(pk.find_peaks(weak, ["part"], "i", "v", distance=5), ["part"], "i", 3)


@query("rank_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def _(t):
    return win.top_k(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 30, "o_orderkey")


@query("rank_topk_by_state", """
SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank
FROM orders QUALIFY rank <= 20""")
def _(t):
    return win.top_k(t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey", ["o_orderstatus"])


@query("rank_global_id", """
WITH s AS (SELECT vec_id, CASE WHEN label = 0 THEN 'new' ELSE 'wear' END AS state FROM embeddings)
SELECT vec_id, state, state || '_' || lpad((row_number() OVER (PARTITION BY state ORDER BY vec_id) - 1)::VARCHAR, 6, '0') AS global_id FROM s""")
def _(t):
    s = t.embeddings.select("vec_id", F.when(F.col("label") == 0, "new").otherwise("wear").alias("state"))
    return win.global_id(s, "state", ["vec_id"])


@query("rank_limit_per_item", """
SELECT * FROM (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey)::INTEGER AS rank FROM part)
WHERE rank <= 3 ORDER BY p_type, rank LIMIT 10""")
def _(t):
    return win.limit_per_item(t.part.select("p_type", "p_partkey", "p_retailprice"), "p_type", ["p_retailprice", "p_partkey"])


@query("win_moving_average", f"""
WITH {_IDX} SELECT part, event_id, round(sum(v) OVER (PARTITION BY part ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS smooth FROM i""")
def _(t):
    d = ordered_columns(t.series, ["part"], ORD, index="i")
    return outputs(win.moving_average(d, ["part"], "i", "v", 6).select("part", "event_id", "smooth"))


@query("win_diff_change", """
WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id AS part, event_id, round(value - p, 6) + 0.0 AS diff, (sign(value) <> sign(p))::INTEGER AS sign_change FROM l""")
def _(t):
    return outputs(win.differences(t.series, ["part"], ORD, "v").select("part", "event_id", "diff", "sign_change"))


_SLOPE = f"""{_IDX}, c AS (SELECT part, i, ln(i + 1.0::DOUBLE) / ln(10.0::DOUBLE) AS x, ln(v) / ln(10.0::DOUBLE) AS y, count(*) OVER (PARTITION BY part) AS n FROM i),
h AS (SELECT *, greatest(floor(round(n * 0.08::DOUBLE) / 2), 3)::BIGINT AS half FROM c WHERE n >= 40),
o AS (SELECT part, i, CASE WHEN count(*) OVER w = 2 * half + 1 THEN regr_slope(y, x) OVER w END AS slope FROM h
 WINDOW w AS (PARTITION BY part ORDER BY i ROWS BETWEEN half PRECEDING AND half FOLLOWING))"""


def _slopes(t):
    """Windows of 8 % of a series' points, for series of 40 points or more."""
    d = ordered_columns(t.series, ["part"], ORD, index="i", total={"n": ("count", F.lit(1))}).where("n >= 40")
    d = d.select("part", "i", "n", F.log10(F.col("i") + 1.0).alias("x"), F.log10("v").alias("y"))
    return win.sliding_slope(d, ["part"], "i", "x", "y", win.half_width(F.col("n"))).select("part", "i", "slope")


@query("win_sliding_slope", f"WITH {_SLOPE} SELECT part, i, round(slope, 5) + 0.0 AS slope FROM o")
def _(t):
    return outputs(_slopes(t), 5)


_RUN = """f AS (SELECT part, i, v, i - row_number() OVER (PARTITION BY part ORDER BY i) AS grp FROM i WHERE v >= 15),
r AS (SELECT part, min(i) AS start, max(i) AS "end", count(*) AS length FROM f GROUP BY part, grp)"""


def _flagged(t):
    return t.series.withColumn("hit", F.col("v") >= 15)


@query("seg_longest_run", f"WITH {_IDX}, {_RUN} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY part ORDER BY length DESC, start) = 1")
def _(t):
    return win.longest_run(_flagged(t), ["part"], ORD, "hit")


@query("seg_first_long_run", f"WITH {_IDX}, {_RUN} SELECT * FROM r WHERE length >= 12 QUALIFY row_number() OVER (PARTITION BY part ORDER BY start) = 1")
def _(t):
    return win.first_long_run(_flagged(t), ["part"], ORD, "hit", 12)


@query("win_majority_label", """
SELECT user_id AS part, min(event_type) AS label FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2
 QUALIFY c = max(c) OVER (PARTITION BY user_id)) GROUP BY 1""")
def _(t):
    return group_mode(t.series, ["part"], "channel", "label")


@query("win_stitch_recordings", """
SELECT CASE WHEN source IN ('src0', 'src1') THEN 'tool_a' WHEN source = 'src2' THEN 'tool_b' ELSE source END AS recording, count(*) AS n,
 sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def _(t):
    d = win.stitch(t.documents, "source", {"tool_a": ["src0", "src1"], "tool_b": ["src2"]}, "recording")
    return d.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_PTS = "p AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS k, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM embeddings)"


@query("fst_basic", f"""
WITH {_PTS}, m AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM p GROUP BY 1)
SELECT vec_id, round(max(x), 6) + 0.0 AS max, round(min(x), 6) + 0.0 AS min, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std,
 round(max(x) - min(x), 6) AS range, round(sqrt(avg(x * x)), 6) AS rms,
 round(sum(x) - (arg_min(x, k) + arg_max(x, k)) / 2, 6) + 0.0 AS area, round(sum(abs(x)) - (abs(arg_min(x, k)) + abs(arg_max(x, k))) / 2, 6) AS abs_area,
 (arg_max(k, (x, -k)))::INTEGER AS peak_index, round(avg(power(x - m, 3)) / power(max(s), 3), 5) + 0.0 AS skew, round(avg(power(x - m, 4)) / power(max(s), 4) - 3, 5) + 0.0 AS kurtosis
FROM p JOIN m USING (vec_id) GROUP BY 1""")
def _(t):
    return outputs(st.basic(t.points, ["vec_id"], "k", "x"), skew=5, kurtosis=5)


_PEAK = f"{_PTS}, q AS (SELECT vec_id, arg_max(k, (x, -k)) AS pk, max(x) AS xp, arg_min(x, k) AS x0, arg_max(x, k) AS xe, max(n) AS n FROM p GROUP BY 1)"


@query("fst_slopes", f"""WITH {_PEAK}
SELECT vec_id, round(CASE WHEN pk > 5 THEN (xp - x0) / pk ELSE 0 END, 6) + 0.0 AS loading_slope,
 round(CASE WHEN pk < n - 5 THEN (xe - xp) / (n - pk) ELSE 0 END, 6) + 0.0 AS unloading_slope FROM q""")
def _(t):
    return outputs(st.slopes(t.points, ["vec_id"], "k", "x"))


@query("fst_settling", f"""WITH {_PEAK}
SELECT vec_id, coalesce(min(k) FILTER (k >= pk AND abs(x) < 0.05::DOUBLE * abs(xp)), max(q.n)) - max(pk) AS settling FROM p JOIN q USING (vec_id) GROUP BY 1""".replace(
    "coalesce(min(k)", "(coalesce(min(k)").replace("max(pk) AS", "max(pk))::INTEGER AS"))
def _(t):
    return st.settling(t.points, ["vec_id"], "k", "x")


@query("fw_zcr_rate", f"""
WITH {_PTS}, l AS (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY k) AS px FROM p)
SELECT vec_id, round(sqrt(avg(x * x)), 6) AS rms, count(*) FILTER (sign(x) <> sign(px)) AS crossings,
 round(count(*) FILTER (sign(x) <> sign(px)) / count(*), 6) AS zcr FROM l GROUP BY 1""")
def _(t):
    return outputs(st.zero_crossings(t.points, ["vec_id"], ["k"], "x"))
