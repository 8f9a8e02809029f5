"""Figures of a task or of the driver that must not grow with the table."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracework.operators import signals as sig


def test_spectra_of_mixed_lengths_at_once(spark):
    """Equal to one transform per series, through lengths above and below the stacked ones, empty and missing series."""
    rng = np.random.default_rng(0)
    x = [rng.normal(size=n) for n in (*rng.integers(1, 12, 600), sig.SHORT + 1, sig.SHORT)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [])], "id int, x array<double>").coalesce(1)
    got = {r["id"]: r["m"] for r in df.select("id", sig.half_spectra("x").alias("m")).collect()}
    assert got.pop(9000) is None and got.pop(9001) is None
    for i, v in enumerate(x):
        np.testing.assert_array_equal(got[i], np.abs(np.fft.rfft(v)))


def test_spectrum_of_peaks_is_read_from_one_table(spark, tmp_path):
    """Peaks read the spectrum several times: from files, not from the transform of the series."""
    from tracework.plans import frequency as fr
    from tracework.plans.registry import Tables

    pdf = pd.DataFrame({"event_id": range(60), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(60), "min"), "user_id": 1, "event_type": "view", "value": np.sin(np.arange(60.0))})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    assert "PythonUDF" not in fr.kept_spectrum(t)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, fr.kept_spectrum(t).collect())) == sorted(map(tuple, fr.spectrum(t).collect()))


def test_driver_takes_one_row_of_weights_an_epoch(spark, monkeypatch):
    """Whatever the number of partitions; the weights are those of averaging all partitions' rows."""
    from pyspark.sql.classic.dataframe import DataFrame
    from tracework.operators.estimators import AutoEncoder

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        taken, whole = [], DataFrame.collect

        def collect(self):
            rows = whole(self)
            if "steps" in self.columns:
                taken.append(len(rows))
            return rows

        monkeypatch.setattr(DataFrame, "collect", collect)
        x = np.random.default_rng(1).normal(size=(400, 3))
        df = spark.createDataFrame(pd.DataFrame({"x": x.tolist()}), "x array<double>").repartition(4)
        model = AutoEncoder(epochs=3).fit(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert taken == [1, 1, 1] and np.isfinite(model.arrays["weights"]).all()


def test_rows_of_one_file_are_dealt_to_several_tasks(spark, monkeypatch):
    """A forest fit keeps its rows with one weight per tree, so a task must not get a whole file of them."""
    from pyspark.ml import Pipeline
    from tracework.operators import models as m

    monkeypatch.setattr(m, "TASK_ROWS", 300, raising=False)
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, d: seen.append(d.rdd.getNumPartitions()) or fit(self, d))
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as double) v", "if(id % 7 > 3, 'high', 'low') kind").coalesce(1)
    out = {r["metric"]: r["value"] for r in m.auto_evaluate(df, "kind", "id", False, trees=5).collect()}
    assert seen == [4] and out["accuracy"] == 1.0 and out["train_rows"] + out["test_rows"] == 1000


def test_batches_of_the_feed_are_whole_slices(spark, tmp_path):
    """Files of a slice hold rows from all of its time: a batch of some of them would make the others' rows late."""
    from tracework.plans import streams
    from tracework.plans.registry import Tables

    n = 9000
    at = np.random.default_rng(4).permutation(n)
    pdf = pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at * 10, "min"), "user_id": at % 3, "event_type": "view", "value": 1.0})
    spark.createDataFrame(pdf).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stream = streams.feed(Tables(spark, str(tmp_path)), file_rows=1000)
    got = streams.live.run_latest(streams.live.sessions(stream, "ts", "4 hours", "part", "1 hour"), "sessions", ["part", "start_us"]).where("n > 0")
    assert sorted((r.part, r.n) for r in got.collect()) == [(0, 3000), (1, 3000), (2, 3000)]


def test_forest_on_any_table_keeps_no_copy_of_it(spark, monkeypatch):
    """The coded table is read again for each pass; results do not need it kept."""
    from pyspark.sql import DataFrame

    from tracework.operators import models as m

    d = spark.range(400).selectExpr("id", "if(id % 9 = 0, null, id % 4) v", "concat('c', id % 3) name", "if(id % 50 = 49, null, double(id % 4)) goal", "if(id % 4 > 1, 'high', 'low') kind")
    for kind in ("persist", "cache"):
        monkeypatch.setattr(DataFrame, kind, lambda self, *a: pytest.fail("a table is kept"))
        monkeypatch.setattr(type(d), kind, lambda self, *a: pytest.fail("a table is kept"))
    for target, regression in (("goal", True), ("kind", False)):
        out = {r["metric"]: r["value"] for r in m.auto_evaluate(d, target, "id", regression, trees=10).collect()}
        assert out["train_rows"] + out["test_rows"] == (392 if regression else 400) and out["test_rows"] > 40
        assert out["r2" if regression else "accuracy"] > 0.7
