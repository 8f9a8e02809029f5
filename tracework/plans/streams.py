"""Streaming operators over the events table, written as a sequence of files first."""
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from tracework.operators import windows as win
from tracework.operators.aggregates import window12
from tracework.plans.registry import outputs, query
from tracework.session import fresh_path
from tracework.streaming import live

BATCHES = 4
#: Rows of a file of the feed; a slice of more is written by several tasks.
FILE_ROWS = 250_000


def feed(t, fmt="parquet", file_rows=FILE_ROWS):
    """events cut into consecutive time slices, one append each, so that batches arrive in time order.

    A batch is a whole slice, however many files hold it: the rows of a slice are in no order of time, so a batch that took
    only some of its files would move the watermark past the others' rows, which would be dropped as late.
    """
    s = t.series.withColumn("ts", F.timestamp_micros("us"))
    lo, hi = s.agg(F.min("us"), F.max("us")).first()
    path = fresh_path(t.spark, "feed")
    step = (hi - lo) // BATCHES + 1
    sizes = dict(s.where("us is not null").groupBy(F.floor((F.col("us") - lo) / step).cast("int")).count().collect())
    # every slice gets as many files as the largest needs, unless the smallest has too few rows to fill them all
    files = max(1, min(-(-max(sizes.values()) // file_rows), min(sizes.values()) // 1000))
    for i in sorted(sizes):
        part = s.where((F.col("us") >= lo + i * step) & (F.col("us") < lo + (i + 1) * step))
        part.repartition(files).write.mode("append").format(fmt).save(path)
    return live.tail(t.spark, path, s.schema, fmt, files_per_batch=files)


@query("str_tail_csv", "SELECT event_id, user_id AS part, event_type AS channel, epoch_us(ts) AS us, value AS v FROM events")
def _(t):
    return live.run(feed(t, "csv").select("event_id", "part", "channel", "us", "v"), "tail")


@query("str_gate", """
SELECT event_id, user_id AS part FROM events r WHERE event_type <> 'view' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'view' AND p.user_id = r.user_id
 AND p.value >= 20 AND p.ts >= r.ts - INTERVAL 2 HOURS AND p.ts <= r.ts + INTERVAL 2 HOURS)""")
def _(t):
    raw, pos = feed(t).where("channel <> 'view'"), feed(t).where("channel = 'view'")
    g = live.gate(raw, pos, "part", "ts", "v", 20.0, "2 hours", "1 hour")
    return live.run(g.select("event_id", "part"), "gate")


_WIN = """WITH i AS (SELECT user_id AS part, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT part, i // 20 AS window_id, v FROM i WHERE i < n - n % 20)"""


@query("str_count_window50", _WIN.replace("20", "50") + """ SELECT part, window_id, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std, round(sum(v), 6) AS v_sum, round(median(v), 6) AS v_median FROM w GROUP BY 1, 2""")
def _(t):
    return outputs(live.run(live.count_windows(feed(t), "part", "us", ["v"], 50), "windows"))


@query("str_tumbling", """
SELECT event_type AS channel, (epoch_us(ts) // 600000000) * 600000 AS start_ms, count(*) AS n, min(value) AS v_min, max(value) AS v_max,
 round(avg(value), 6) AS v_mean, round(stddev_pop(value), 6) AS v_std FROM events GROUP BY 1, 2""")
def _(t):
    frames = live.tumbling(feed(t), "ts", "10 minutes", ["channel"], ["v"], "1 hour")
    return outputs(live.run_latest(frames, "frames", ["channel", "start_ms"]))


@query("str_session", """
WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 14400000000 THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id AS part, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(t):
    """All sessions, those still open at the end included."""
    return live.run_latest(live.sessions(feed(t), "ts", "4 hours", "part", "1 hour"), "sessions", ["part", "start_us"]).where("n > 0")


def _model(t):
    """Scaler and linear classifier fitted on batch windows: is the window mean above 30?"""
    w = window12(win.count_windows(t.series, ["part"], ["us", "event_id"], 20), ["part", "window_id"], ["v"])
    d = w.withColumn("label", (F.col("v_mean") > 30).cast("double"))
    stages = [VectorAssembler(inputCols=["v_mean", "v_std", "v_sum", "v_median"], outputCol="f"), StandardScaler(inputCol="f", outputCol="s", withMean=True),
              LinearSVC(featuresCol="s", maxIter=10)]
    return Pipeline(stages=stages).fit(d)


def _scored(t):
    w = live.count_windows(feed(t), "part", "us", ["v"], 20)
    return live.score(w, _model(t)).select("part", "window_id", F.col("prediction").cast("int").alias("pred"))


@query("str_score")
def _(t):
    return live.run(_scored(t), "scored")


@query("str_vote", """
WITH g AS (SELECT user_id AS part, count(*) FILTER (value > 20) AS n_worn, count(*) FILTER (value <= 20) AS n_new FROM events GROUP BY 1)
SELECT *, CASE WHEN n_worn > n_new THEN 'worn' WHEN n_worn < n_new THEN 'new' ELSE 'uncertain' END AS verdict, CASE WHEN n_new > (n_new + n_worn) / 2 THEN 'new' ELSE 'worn' END AS dashboard FROM g""")
def _(t):
    d = feed(t).withColumn("pred", (F.col("v") > 20).cast("int"))
    return live.run_latest(live.vote(d, ["part"], "pred"), "votes", ["part"])


@query("str_threshold_events", """
SELECT event_id, user_id AS part, value AS v, CASE WHEN value > 100 THEN 'overshoot' ELSE 'undershoot' END AS event, CASE WHEN value > 100 THEN 100.0 ELSE 0.5 END::DOUBLE AS threshold FROM events WHERE value > 100 OR value < 0.5""".replace(
    "CASE WHEN value > 100 THEN 100.0 ELSE 0.5 END::DOUBLE", "(CASE WHEN value > 100 THEN 100.0 ELSE 0.5 END)::DOUBLE"))
def _(t):
    return live.run(live.threshold_events(feed(t), "v", 100.0, 0.5).select("event_id", "part", "v", "event", "threshold"), "events")


@query("str_dedup", "SELECT DISTINCT value AS v FROM events")
def _(t):
    d = live.dedup(feed(t), "ts", ["v"], "60 days")
    return live.run(d.select("v"), "dedup")
