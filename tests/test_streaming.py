"""Stateful streaming: windows and sessions carried over micro-batches, late rows, open sessions, expiry of state."""
import pandas as pd
import pytest

from tracework.session import fresh_path
from tracework.streaming import live

#: The watermark starts at 0, so no row may lie there.
START = 10_000
SCHEMA = "k long, ts timestamp, us long, v double"


def feed(spark, batches):
    """One file per micro-batch of (key, second, value) rows."""
    path = fresh_path(spark, "feed")
    for rows in batches:
        pdf = pd.DataFrame([(k, pd.Timestamp(s + START, unit="s"), int((s + START) * 1e6), float(v)) for k, s, v in rows], columns=["k", "ts", "us", "v"])
        spark.createDataFrame(pdf, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return live.tail(spark, path, SCHEMA, "parquet")


@pytest.fixture
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def test_windows_over_batches(utc):
    rows = [[(1, s, s) for s in (3, 1, 2)], [(1, 4, 4), (2, 4, 9)], [(1, s, s) for s in (7, 6, 5)], [(2, 8, 11), (1, 8, 8)]]
    got = live.run(live.count_windows(feed(utc, rows), "k", "us", ["v"], 4), "windows").orderBy("k", "window_id").collect()
    assert [(r.k, r.window_id, r.v_sum, r.v_median) for r in got] == [(1, 0, 10.0, 2.5), (1, 1, 26.0, 6.5)]
    assert got[0].v_std == pytest.approx(1.2909944)


def test_silent_key_loses_its_tail(utc):
    """Key 1 stops after five rows; the watermark passes its idle time, so the row it kept is gone when it comes back."""
    rows = [[(1, s, s) for s in range(5)], [(2, 500, 0)], [(2, 600, 0)], [(2, 700, 0)], [(1, s, 100) for s in range(800, 804)]]
    out = live.count_windows(feed(utc, rows), "k", "us", ["v"], 4, clock="ts", idle="60 seconds", late="5 seconds")
    got = live.run(out, "windows").where("k = 1").orderBy("v_sum").collect()
    assert [(r.window_id, r.v_sum) for r in got] == [(0, 6.0), (0, 400.0)]


def test_sessions_open_and_joined(utc):
    """A gap of exactly the limit stays inside; a late row joins two sessions; the last session is open and comes out."""
    rows = [[(1, 0, 0), (1, 60, 0), (1, 121, 0)], [(2, 100, 0), (1, 200, 0)], [(1, 215, 0), (1, 160, 0), (2, 161, 0)], [(1, 900, 0)]]
    out = live.run_latest(live.sessions(feed(utc, rows), "ts", "60 seconds", "k", "100 seconds"), "sessions", ["k", "start_us"]).where("n > 0")
    assert sorted((r.k, r.start_us // 10**6 - START, r.n) for r in out.collect()) == [(1, 0, 2), (1, 121, 4), (1, 900, 1), (2, 100, 1), (2, 161, 1)]


def test_sessions_leave_the_state(utc):
    rows = [[(k, 10 * k, 0) for k in range(20)], [(99, 5000, 0)], [(99, 6000, 0)], [(99, 7000, 0)]]
    stream = live.sessions(feed(utc, rows), "ts", "60 seconds", "k", "5 seconds")
    left = []
    path = fresh_path(utc, "state")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda d, n: d.count()).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    left = utc.read.format("statestore").option("stateVarName", "open").load(path).select("key.k").distinct().collect()
    assert [r.k for r in left] == [99]
