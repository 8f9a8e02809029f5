"""Aggregations and reshaping on the given tables."""
from pyspark.sql import functions as F

from tracework.functions.numeric import log_bin
from tracework.operators import aggregates as a
from tracework.operators import joins as j
from tracework.operators import windows as win
from tracework.operators.ordered import ordered_columns
from tracework.plans.joins import CHANNELS
from tracework.plans.registry import outputs, query

_IDX = """i AS (SELECT user_id AS part, event_id, event_type, value AS v, epoch_us(ts) AS us,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


@query("agg_window12", f"""
WITH {_IDX}
SELECT part, i // 10 AS window_id, count(*) AS n, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std,
 round(sum(v), 6) AS v_sum, round(median(v), 6) AS v_median,
 (CASE WHEN 2 * count(*) FILTER (event_type = 'view') > count(*) THEN 1 ELSE 0 END)::INTEGER AS label
FROM i WHERE i < n - n % 10 GROUP BY 1, 2""")
def _(t):
    s = t.series.withColumn("label", (F.col("channel") == "view").cast("int"))
    return outputs(a.window12(win.count_windows(s, ["part"], ["us", "event_id"], 10), ["part", "window_id"], ["v"], "label"))


@query("agg_raw_stats", """
SELECT user_id AS part, max(value) AS raw_max, min(value) AS raw_min, round(avg(value), 6) AS raw_mean,
 round(stddev_pop(value), 6) AS raw_std, round(max(value) - min(value), 6) AS raw_range,
 round(sum(value) - (arg_min(value, ts) + arg_max(value, ts)) / 2, 6) AS raw_area FROM events GROUP BY 1""")
def _(t):
    return outputs(a.raw_stats(t.series, ["part"], ["us", "event_id"], "v"))


@query("agg_describe", """
SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
 min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75
FROM lineitem GROUP BY 1""")
def _(t):
    return outputs(a.describe_by(t.lineitem, ["l_returnflag"], "l_extendedprice"), 4)


@query("agg_group_size", """
SELECT l_returnflag, l_linestatus, l_quantity >= 25 AS valid, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _(t):
    d = t.lineitem.withColumn("valid", F.col("l_quantity") >= 25)
    return d.groupBy("l_returnflag", "l_linestatus", "valid").agg(F.count(F.lit(1)).alias("n"))


_EFF = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _unpivot_sql(cols, keep, table="lineitem"):
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c}::DOUBLE AS x FROM {table}" for c in cols)


@query("agg_effect_size", f"""
WITH u AS ({_unpivot_sql(_EFF, 'l_returnflag')}),
g AS (SELECT feature, avg(x) FILTER (l_returnflag = 'N') AS m0, avg(x) FILTER (l_returnflag = 'R') AS m1,
 stddev_pop(x) FILTER (l_returnflag = 'N') AS s0, stddev_pop(x) FILTER (l_returnflag = 'R') AS s1 FROM u GROUP BY 1)
SELECT feature, round(m0, 4) AS ref_mean, round(m1, 4) AS test_mean, round(s0, 4) AS ref_std, round(s1, 4) AS test_std,
 round(m1 - m0, 4) + 0.0 AS difference, round((m1 - m0) / sqrt(0.5 * (s0*s0 + s1*s1)), 6) + 0.0 AS effect,
 round(abs((m1 - m0) / sqrt(0.5 * (s0*s0 + s1*s1))), 6) AS abs_effect FROM g""")
def _(t):
    return outputs(a.effect_size(t.lineitem, "l_returnflag", _EFF, "N", "R"), 4, effect=6, abs_effect=6)


@query("agg_corr_matrix", " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS r FROM lineitem"
    for i, x in enumerate(_EFF) for y in _EFF[i + 1:]))
def _(t):
    return outputs(a.corr_matrix(t.lineitem, _EFF))


@query("agg_corr_label", f"""
WITH u AS ({_unpivot_sql(('o_totalprice', 'o_custkey', 'o_orderkey'), '(o_totalprice > 250000)::INTEGER::DOUBLE AS y', 'orders')})
SELECT feature, round(corr(x, y), 6) AS r FROM u GROUP BY 1 HAVING abs(corr(x, y)) > 0.7""")
def _(t):
    d = t.orders.withColumn("y", (F.col("o_totalprice") > 250000).cast("int"))
    return outputs(a.corr_label(d, ["o_totalprice", "o_custkey", "o_orderkey"], "y"))


@query("agg_zscore_ref", """
WITH x AS (SELECT vec_id, label, embedding[1]::DOUBLE AS s FROM embeddings),
r AS (SELECT avg(s) AS m, stddev_pop(s) AS d FROM x WHERE label = 0)
SELECT vec_id, label, round((s - m) / greatest(d, 1e-12), 6) AS s_z FROM x, r""")
def _(t):
    x = t.embeddings.select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("s"))
    return outputs(j.apply_reference_scale(x, x.where("label = 0"), ["s"]).drop("s"))


@query("agg_weighted_mean", """
SELECT l_suppkey, round(CASE WHEN sum(l_tax - 0.04) > 0 THEN sum((l_tax - 0.04) * l_quantity) / sum(l_tax - 0.04) ELSE avg(l_quantity) END, 4) AS wmean,
 round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1""")
def _(t):
    return outputs(t.lineitem.groupBy("l_suppkey").agg(
        a.weighted_mean("l_quantity", F.col("l_tax") - 0.04).alias("wmean"),
        a.weighted_mean("l_extendedprice", "l_quantity").alias("price")), 4)


@query("agg_bin_mean_two_level", """
WITH b AS (SELECT year(l_shipdate) AS snap, l_tax AS v, l_quantity AS w,
  CASE WHEN l_extendedprice >= 5000 AND l_extendedprice < 100000 THEN
   least(floor((ln(l_extendedprice) - ln(5000)) / ((ln(100000) - ln(5000)) / 35)), 34)::INTEGER END AS bin FROM lineitem),
i AS (SELECT snap, bin, sum(w * v) / sum(w) AS m, count(*) AS c, sum(w) AS w FROM b WHERE bin IS NOT NULL GROUP BY 1, 2),
o AS (SELECT bin, avg(m) AS mean, count(*) AS snapshots, sum(c)::BIGINT AS occupancy, sum(w) AS weight FROM i GROUP BY 1)
SELECT r.bin::INTEGER AS bin, round(mean, 6) AS mean, coalesce(snapshots, 0) AS snapshots, coalesce(occupancy, 0) AS occupancy,
 round(coalesce(weight, 0), 6) AS weight FROM range(35) r(bin) LEFT JOIN o ON o.bin = r.bin""")
def _(t):
    d = t.lineitem.select(F.year("l_shipdate").alias("snap"), F.col("l_tax").alias("v"), F.col("l_quantity").alias("w"),
                          log_bin("l_extendedprice", 5000.0, 100000.0, 35).alias("bin"))
    return outputs(a.bin_means(d, "snap", "bin", "v", "w", 35))


@query("agg_histogram", """
WITH b AS (SELECT event_type, least(floor((value - 0.0) / 500.0::DOUBLE * 40), 39)::INTEGER AS bin FROM events WHERE value >= 0 AND value <= 500),
c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT event_type, bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * 12.5::DOUBLE), 6) AS density FROM c""")
def _(t):
    return outputs(a.histogram(t.events, ["event_type"], "value", 0.0, 500.0, 40))


@query("agg_boxplot", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""")
def _(t):
    return outputs(a.boxplot(t.events, ["event_type"], "value"))


@query("agg_curve_mean_std", """
WITH p AS (SELECT label = 0 AS is_new, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CASE WHEN is_new THEN 'new' ELSE 'wear' END AS state, k::INTEGER AS k, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std FROM p GROUP BY 1, 2""")
def _(t):
    d = t.points.withColumn("state", F.when(F.col("label") == 0, "new").otherwise("wear"))
    return outputs(a.curve_mean_std(d, ["state", "k"], "x"))


@query("agg_segment_stats", """
WITH p AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, round(avg(x) FILTER (k < 10), 6) + 0.0 AS pre_mean, round(stddev_pop(x) FILTER (k < 10), 6) AS pre_std,
 round(min(x) FILTER (k < 10), 6) + 0.0 AS pre_min, round(max(x) FILTER (k < 10), 6) + 0.0 AS pre_max,
 round(min(x) FILTER (k >= 31 AND k < 47), 6) + 0.0 AS post_min, round(avg(x) FILTER (k >= 31 AND k < 47), 6) + 0.0 AS post_mean FROM p GROUP BY 1""")
def _(t):
    return outputs(a.segment_stats(t.points, ["vec_id"], "k", "x", (0, 10), (31, 47)))


@query("agg_time_frame", """
SELECT event_type AS channel, (epoch_us(ts) // 600000000) * 600000 AS start_ms, count(*) AS n, min(value) AS v_min, max(value) AS v_max,
 round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std FROM events GROUP BY 1, 2""")
def _(t):
    s = t.series.withColumn("ts", F.timestamp_micros("us"))
    return outputs(a.time_frames(s, ["channel"], "ts", "10 minutes", ["v"]))


@query("agg_sample_rate", """
SELECT event_type AS channel, count(*) AS n, round(count(*) / (max(epoch_us(ts)) / 1e6::DOUBLE - min(epoch_us(ts)) / 1e6::DOUBLE), 9) AS rate,
 round((max(epoch_us(ts)) / 1e6::DOUBLE - min(epoch_us(ts)) / 1e6::DOUBLE) / (count(*) - 1), 4) AS interval FROM events GROUP BY 1""")
def _(t):
    return outputs(a.sample_rate(t.series, ["channel"], F.col("us") / 1e6), 9, interval=4)


@query("agg_channel_profile", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events)
SELECT event_type AS channel, count(*) AS length, 'double' AS dtype, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
 round(stddev_pop(value), 6) AS std, list(value ORDER BY r) FILTER (r <= 10) AS first_values FROM i GROUP BY 1""")
def _(t):
    return outputs(a.channel_profile(t.series, "channel", ["us", "event_id"], "v"))


@query("agg_metric_delta", """
WITH x AS (SELECT label = 0 AS n, embedding[1]::DOUBLE AS s1, embedding[2]::DOUBLE AS s2 FROM embeddings),
u AS (SELECT n, 's1' AS feature, s1 AS v FROM x UNION ALL SELECT n, 's2', s2 FROM x)
SELECT feature, round(avg(v) FILTER (n), 6) + 0.0 AS mean_ref, round(avg(v) FILTER (NOT n), 6) + 0.0 AS mean_test,
 round(avg(v) FILTER (NOT n) - avg(v) FILTER (n), 6) + 0.0 AS delta FROM u GROUP BY 1""")
def _(t):
    x = t.embeddings.select(F.when(F.col("label") == 0, "new").otherwise("wear").alias("state"),
                            F.element_at("embedding", 1).alias("s1"), F.element_at("embedding", 2).alias("s2"))
    return outputs(a.metric_delta(x, "state", ["s1", "s2"], "new", "wear"))


@query("agg_vote", """
WITH g AS (SELECT source, count(*) FILTER (quality = 1) AS n_worn, count(*) FILTER (quality = 0) AS n_new
 FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN n_worn > n_new THEN 'worn' WHEN n_worn < n_new THEN 'new' ELSE 'uncertain' END AS verdict,
 CASE WHEN n_new > (n_new + n_worn) / 2 THEN 'new' ELSE 'worn' END AS dashboard FROM g""")
def _(t):
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return a.vote(d, ["source"], "quality")


@query("set_union_all", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def _(t):
    c = t.customer.selectExpr("c_custkey id", "c_name name", "c_acctbal bal", "c_mktsegment segment")
    s = t.supplier.selectExpr("s_suppkey id", "s_name name", "s_acctbal bal")
    return c.unionByName(s, allowMissingColumns=True)


@query("sort_time", "SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def _(t):
    """Global position in time order without a single sorting task."""
    return ordered_columns(t.series.select("event_id", "us"), [], ["us", "event_id"], index="pos")


@query("set_dedup_key", """
SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def _(t):
    d = t.documents.withColumn("h", F.md5("text")).select("doc_id", "source", "n_chars", "h")
    return win.first_per_key(d, ["h"], ["doc_id"]).drop("h")


@query("rsh_melt", _unpivot_sql(("l_quantity", "l_discount", "l_tax"), "l_orderkey, l_partkey, l_linenumber").replace("AS feature", "AS kind").replace("AS x", "AS value"))
def _(t):
    return t.lineitem.unpivot(["l_orderkey", "l_partkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "kind", "value")


@query("rsh_drop_duplicate_columns", "SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    from tracework.operators.explore import drop_duplicate_columns

    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_nationkey", F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_name").alias("n_name"), "n_regionkey")
    return drop_duplicate_columns(joined)


@query("rsh_pivot_features", "SELECT user_id AS part, " + ", ".join(
    f"round(sum(value) FILTER (event_type = '{c}'), 6) AS {c}_total, count(*) FILTER (event_type = '{c}') AS {c}_n" for c in CHANNELS) + " FROM events GROUP BY 1")
def _(t):
    w = j.pivot_features(t.series, ["part"], "channel", CHANNELS, {"total": F.sum("v"), "n": F.count("v")})
    return outputs(w.na.fill(0, [f"{c}_n" for c in CHANNELS]))
