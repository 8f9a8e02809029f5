"""Range-split ordered columns equal plain pandas, also with one hot key."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracework.operators import joins as j
from tracework.operators import windows as win
from tracework.operators.features_freq import local_maxima
from tracework.operators.ordered import group_mode, group_quantiles, ordered_columns, range_count
from tracework.session import ROWS_PER_RANGE


@pytest.fixture
def frame():
    rng = np.random.default_rng(1)
    n = 400
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 6, n))  # key 0 is hot
    v = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 20, n).astype(float))
    return pd.DataFrame({"k": key, "t": rng.permutation(n), "id": np.arange(n), "v": v})


def test_all_columns(small_ranges, frame):
    d = small_ranges.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ordered_columns(d, ["k"], ["t", "id"], index="i", lag={"p": "v"}, lead={"q": "v"}, running={"s": "v"},
                          last={"l": "v"}, next={"n": "v"}, total={"tot": ("sum", F.col("v")), "c": ("count", F.lit(1))})
    got = got.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = frame.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")["v"]
    pd.testing.assert_series_equal(got["i"], want.groupby("k").cumcount(), check_names=False, check_dtype=False)
    for c, w in {"p": g.shift(1), "q": g.shift(-1), "l": g.ffill(), "n": g.bfill()}.items():
        pd.testing.assert_series_equal(got[c].astype(float), w, check_names=False)
    s = want["v"].fillna(0).groupby(want["k"]).cumsum()
    has = want["v"].notna().groupby(want["k"]).cumsum() > 0
    np.testing.assert_allclose(got.loc[has, "s"].astype(float), s[has])
    np.testing.assert_allclose(got["tot"].astype(float), g.transform("sum"))
    assert (got["c"] == want.groupby("k")["id"].transform("count")).all()


def test_null_keys_and_order_values(spark, small_ranges):
    """Ranges give what the plain window gives, also for null keys, null order values and both."""
    rows = [(None if i % 4 == 0 else i % 4, None if i % 9 == 0 else float(i * 37 % 101), i, None if i % 5 == 0 else i) for i in range(120)]
    d = spark.createDataFrame(rows, "k int, t double, id int, v int")
    def run(ranges):
        got = ordered_columns(d, ["k"], ["t", "id"], ranges=ranges, index="i", lag={"p": "v"}, lead={"q": "v"}, running={"s": "v"},
                              last={"l": "v"}, next={"n": "v"}, total={"tot": ("sum", F.col("v")), "c": ("count", F.lit(1))})
        return sorted(map(tuple, got.select("id", "k", "t", "i", "p", "q", "s", "l", "n", "tot", "c").collect()))
    assert run(None) == run(1) == run(2) == run(40)
    windows = win.count_windows(d, ["k"], ["t", "id"], size=10)
    assert windows.count() == 120 and windows.where("k is null").count() == 30


def test_hot_clock_value_is_split(spark):
    """Nine tenths of the rows share one key and one clock value; the further order columns cut them all the same."""
    d = spark.range(4000).selectExpr("1 k", "case when id % 10 = 0 then id else 7 end t", "id", "cast(id % 13 as double) v")
    columns = dict(index="i", lag={"p": "v"}, lead={"q": "v"}, running={"s": "v"}, last={"l": "v"}, next={"n": "v"}, total={"c": ("count", F.lit(1))})
    got = ordered_columns(d, ["k"], ["t", "id"], ranges=16, **columns)
    want = ordered_columns(d, ["k"], ["t", "id"], ranges=1, **columns)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    path = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in path
    file = [f for f in got.inputFiles()]
    sizes = [spark.read.parquet(f).count() for f in file]
    assert len(sizes) > 8 and max(sizes) < 4000 / 16 * 4


def test_no_job_to_choose_ranges(spark, small_ranges):
    """The number of ranges comes from the plan; input of unknown size alone is counted."""
    from conftest import SF
    from tracework.operators.ordered import range_count
    tracker = spark.sparkContext.statusTracker()
    d = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 5").groupBy("l_orderkey").count()
    spark.sparkContext.setJobGroup("ranges", "")
    assert range_count(d) > 10 and len(tracker.getJobIdsForGroup("ranges")) == 0
    assert range_count(spark.createDataFrame([(1,)] * 20, "a int").repartition(2)) == 3


def test_types_through_ranges(spark):
    """Dates, times, decimals, strings, structs and arrays ride along; keys may be missing or not a number."""
    d = spark.range(60).selectExpr(
        "if(id % 3 = 0, null, if(id % 3 = 1, double('nan'), 1.5)) k", "id", "timestamp_micros(id * 1000) ts", "date_add(date'2020-01-01', cast(id as int)) day",
        "cast(id as decimal(12,2)) amount", "named_struct('a', id, 'b', array(id)) s", "if(id % 4 = 0, null, cast(id as string)) name", "cast(id as int) n")
    columns = dict(lag={"p": "s"}, lead={"q": "day"}, last={"l": "name"}, next={"x": "name"}, running={"r": "n"}, total={"m": ("max", F.col("amount")), "z": ("min", F.col("name")), "t": ("sum", F.col("n"))})
    a, b = (ordered_columns(d, ["k"], ["id"], ranges=r, **columns) for r in (1, 9))
    assert dict(a.dtypes) == dict(b.dtypes)
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


def test_without_keys(small_ranges, frame):
    d = small_ranges.createDataFrame(frame)
    got = ordered_columns(d, [], ["t"], index="i").toPandas()
    assert (got["i"] == got["t"]).all()


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_asof_equals_pandas(small_ranges, direction, by):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"k": rng.integers(0, 3, 120), "t": np.sort(rng.integers(0, 500, 120)), "id": np.arange(120)})
    right = pd.DataFrame({"k": rng.integers(0, 3, 60), "t": np.sort(rng.choice(500, 60, replace=False)), "r_id": np.arange(60)})
    r = right if by else right.drop(columns="k")
    got = j.asof_join(small_ranges.createDataFrame(left), small_ranges.createDataFrame(r), "t", by, direction, "id", "r_id")
    got = got.toPandas().sort_values("id")["r_id"].astype(float).to_numpy()
    want = pd.merge_asof(left, r, on="t", by=by or None, direction=direction).sort_values("id")["r_id"].astype(float).to_numpy()
    np.testing.assert_array_equal(got, want)


def test_quantiles_and_mode(small_ranges, frame):
    d = small_ranges.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = group_quantiles(d, ["k"], "v", {"a": 0.1, "m": 0.5}).toPandas().set_index("k").sort_index()
    want = frame.groupby("k")["v"].quantile([0.1, 0.5]).unstack()
    np.testing.assert_allclose(got[["a", "m"]].to_numpy(float), want.to_numpy())
    mode = group_mode(d, ["k"], "v", "m").toPandas().set_index("k")["m"].sort_index()
    assert mode.tolist() == frame.groupby("k")["v"].agg(lambda x: x.mode()[0]).tolist()


def test_sessions_and_runs(small_ranges):
    t = [0, 10, 70, 131, 191, 192, 300]
    d = small_ranges.createDataFrame(pd.DataFrame({"k": 1, "t": t, "hit": [True, True, False, True, True, True, False]}))
    assert [r["session"] for r in win.gap_sessions(d, ["k"], ["t"], 60).orderBy("t").collect()] == [0, 0, 0, 1, 1, 1, 2]
    r = win.longest_run(d, ["k"], ["t"], "hit").first()
    assert (r["start"], r["end"], r["length"]) == (3, 5, 3)


def test_local_maxima_with_plateaus(small_ranges):
    x = [0, 1, 0, 2, 2, 2, 1, 3, 3, 4, 4, 5, 0, 0, 7, 7]
    d = small_ranges.createDataFrame(pd.DataFrame({"k": 1, "i": range(len(x)), "v": [float(v) for v in x]}))
    assert sorted(r["i"] for r in local_maxima(d, ["k"], "i", "v").collect()) == [1, 4, 11]


def test_centred_window_across_blocks(spark):
    n = 50
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(n), "v": np.arange(n, dtype=float) ** 2}))
    got = win.centred(d, ["k"], "i", 4, {"s": F.sum("v")}, block=5).orderBy("i").toPandas()["s"]
    want = [sum(float(q) ** 2 for q in range(max(0, i - 4), min(n, i + 5))) for i in range(n)]
    assert got.tolist() == want and len(got) == n


@pytest.mark.parametrize("half", [3, 40, 200])
def test_sliding_slope_of_any_width(small_ranges, half):
    rng = np.random.default_rng(6)
    n = 420
    pdf = pd.DataFrame({"k": [1] * n + [2] * 30, "i": [*range(n), *range(30)], "x": np.log10(np.arange(n + 30) + 1), "y": rng.normal(size=n + 30) + 100})
    pdf.loc[50:54, "y"] = np.nan
    d = small_ranges.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = win.sliding_slope(d, ["k"], "i", "x", "y", half).orderBy("k", "i").toPandas()["slope"].to_numpy(float)
    want = np.full(n + 30, np.nan)
    for k, start, size in ((1, 0, n), (2, n, 30)):
        for i in range(half, size - half):
            part = pdf.iloc[start + i - half:start + i + half + 1].dropna()
            if len(part) >= 5:
                want[start + i] = np.polyfit(part["x"], part["y"], 1)[0]
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-9)


def test_ranges_of_compressed_rows(spark, tmp_path):
    """A range holds no more than a few times ``rowsPerRange`` rows, also of a table whose rows take few bytes in its files."""
    path = str(tmp_path / "t")
    spark.range(0, 200_000, 1, 1).select("id", (F.xxhash64("id") % 1000 / 8.0).alias("v"), F.lit("x").alias("k")).write.parquet(path)
    d = spark.read.parquet(path)
    spark.conf.set(ROWS_PER_RANGE, "5000")
    try:
        assert range_count(d) >= 12
    finally:
        spark.conf.unset(ROWS_PER_RANGE)
