"""Fitted models: equal to NumPy, saved and loaded in another session, applied to streams; kernel features; tables of any columns."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracework.operators import models as m
from tracework.operators.estimators import ArrayScaler, AutoEncoder, AutoEncoderModel, IsolationForest, IsolationForestModel, KernelFeatures, PcaReconstruction, PcaReconstructionModel
from tracework.session import fresh_path
from tracework.streaming import live


@pytest.fixture(scope="module")
def good(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) @ rng.normal(size=(3, 6)) + 0.2 * rng.normal(size=(240, 6)) + 4
    return x, spark.createDataFrame(pd.DataFrame({"id": range(240), "x": x.tolist()}), "id long, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def mixed(spark, good):
    rows = [(i, v.tolist()) for i, v in enumerate(good[0])] + [(900, None), (901, [1.0]), (902, (good[0][0] + 30 * np.array([1, -1, 1, 1, -1, 1])).tolist())]
    return spark.createDataFrame(rows, "id long, x array<double>")


def scores(df):
    return {r["id"]: r["score"] for r in df.select("id", "score").collect()}


def test_scaler(good):
    x, df = good
    got = ArrayScaler(inputCol="x", outputCol="z").fit(df).transform(df).orderBy("id").toPandas()["z"]
    np.testing.assert_allclose(np.stack(got), (x - x.mean(0)) / x.std(0), atol=1e-9)


@pytest.mark.parametrize("estimator, kind", [(PcaReconstruction(share=0.9), PcaReconstructionModel), (IsolationForest(trees=40), IsolationForestModel), (AutoEncoder(epochs=2), AutoEncoderModel)])
def test_fit_save_load_apply(spark, good, mixed, estimator, kind):
    model = estimator.fit(good[1])
    want = scores(model.transform(mixed))
    assert want[900] is None and want[901] is None and want[902] > np.quantile([want[i] for i in range(240)], 0.95)
    path = fresh_path(spark, "estimator")
    Pipeline(stages=[model]).fit(good[1]).write().save(path)
    other = spark.newSession()
    loaded = PipelineModel.load(path)
    assert isinstance(loaded.stages[0], kind) and loaded.stages[0].uid == model.uid
    again = other.createDataFrame(mixed.collect(), mixed.schema)
    assert scores(loaded.transform(again)) == want
    # the same model on a stream of files
    feed = fresh_path(spark, "feed")
    mixed.repartition(3).write.parquet(feed)
    scored = live.run(live.score(live.tail(spark, feed, mixed.schema, "parquet"), loaded), "scored")
    assert scores(scored) == want


def test_estimator_is_saved_too(spark):
    path = fresh_path(spark, "estimator")
    Pipeline(stages=[AutoEncoder(epochs=7, inputCol="y")]).write().save(path)
    stage = Pipeline.load(path).getStages()[0]
    assert stage.getOrDefault("epochs") == 7 and stage.getInputCol() == "y"


def test_autoencoder_is_plain_training_on_one_partition(spark):
    """One partition, one epoch: the weights follow from mini-batch Adam, each step with the weights of the step before."""
    from tracework.operators import estimators as e
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 4))
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist()}), "x array<double>").coalesce(1)
    model = AutoEncoder(epochs=1, batch=16).fit(df)
    z = (x - x.mean(0)) / x.std(0)
    order = [tuple(np.round(r["z"], 9)) for r in df.select(e.scale("x", model.arrays).alias("z")).orderBy(F.xxhash64("z", F.lit(42))).collect()]
    z = np.array(sorted(z, key=lambda v: order.index(tuple(np.round(v, 9)))))
    dims, draw = (4, *e.HIDDEN, 4), np.random.default_rng(42)
    w = np.concatenate([np.concatenate([draw.uniform(-1, 1, a * b), draw.uniform(-1, 1, b)]) / np.sqrt(a) for a, b in zip(dims, dims[1:], strict=False)])
    a, b = np.zeros_like(w), np.zeros_like(w)
    z = z[np.random.default_rng([42, 0, 0]).permutation(70)]
    for step, at in enumerate(range(0, 70, 16), 1):
        part, layers = z[at : at + 16], e._layers(w, dims)
        g = e._gradient(layers, part)
        for i in (0, 500, len(w) - 1):  # the gradient itself, by differences
            up, down = w.copy(), w.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            loss = [((e._forward(e._layers(v, dims), part)[-1] - part) ** 2).mean() for v in (up, down)]
            assert abs((loss[0] - loss[1]) / 2e-6 - g[i]) < 1e-5
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w = w - 1e-3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    np.testing.assert_allclose(model.arrays["weights"], w, atol=1e-8)


def test_kernel_features_approximate_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 10))
    want = (0.1 * x @ x.T + 1) ** 3
    exact = KernelFeatures(kernel="poly", width=286, gamma=0.1).features(x)
    np.testing.assert_allclose(exact @ exact.T, want, atol=1e-9)
    sketch = KernelFeatures(kernel="poly", width=285, gamma=0.1).features(x)
    assert sketch.shape == (40, 285) and np.corrcoef((sketch @ sketch.T).ravel(), want.ravel())[0, 1] > 0.9
    rbf = KernelFeatures(kernel="rbf", width=8192, gamma=0.1).features(x)
    assert np.abs(rbf @ rbf.T - np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))).max() < 0.06


def test_polynomial_machine_is_as_good_as_the_full_expansion(spark):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 5))
    y = (x[:, 0] * x[:, 1] * x[:, 2] + x[:, 3] ** 2 > 0.8).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"id": range(900), "x": x.tolist(), "label": y, "weight": 1.0})).withColumn("features", array_to_vector("x")).cache()
    train, test = d.where("id < 600"), d.where("id >= 600")
    full = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="s", withMean=True), PolynomialExpansion(degree=3, inputCol="s", outputCol="e"), LinearSVC(featuresCol="e", regParam=0.01, maxIter=50)])
    right = lambda p: p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    want = right(full.fit(train).transform(test))
    assert right(m.svm(train, test, "poly")) > want - 0.02
    assert right(m.svm(train, test, "poly", width=55)) > 0.6  # one monomial too many: the sketch
    path = fresh_path(spark, "svm")
    model = m.svm_pipeline("rbf", width=64).fit(train)
    model.write().save(path)
    cols = ["id", "prediction"]
    assert PipelineModel.load(path).transform(test).select(cols).collect() == model.transform(test).select(cols).collect()


def test_tables_with_gaps_and_many_categories(spark):
    """10,000 categories, nulls in every column, NaN and infinite numbers: all rows are used."""
    d = spark.range(12_000).selectExpr(
        "id", "if(id % 11 = 0, null, concat('c', id % 10000)) name", "if(id % 7 = 0, null, if(id % 500 = 1, double('nan'), if(id % 500 = 2, double('infinity'), id % 13))) v",
        "if(id % 5 = 0, null, cast(id % 3 as int)) w", "id % 4 = 0 flag", "if(id % 100 = 99, null, if(id % 13 > 6, 'high', 'low')) kind", "cast(id % 13 as double) goal")
    for target, regression in (("kind", False), ("goal", True)):
        out = {r["metric"]: r["value"] for r in m.auto_evaluate(d.drop("goal" if target == "kind" else "kind"), target, "id", regression, trees=10).collect()}
        assert out["train_rows"] + out["test_rows"] == (11_880 if target == "kind" else 12_000)
        assert out["accuracy" if target == "kind" else "r2"] > 0.7


def test_autoencoder_takes_all_epochs_of_a_small_partition_in_one_job(spark, monkeypatch):
    from tracework.operators import estimators as e
    x = np.random.default_rng(6).normal(size=(70, 4))
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist()}), "x array<double>").coalesce(1)
    spark.sparkContext.setJobGroup("epochs", "epochs")
    once = AutoEncoder(epochs=12, batch=16).fit(df).arrays["weights"]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("epochs")) < 12
    monkeypatch.setattr(e, "HELD", 0)  # a job per epoch, as for larger tables
    np.testing.assert_array_equal(AutoEncoder(epochs=12, batch=16).fit(df).arrays["weights"], once)
