"""Models and vector search against NumPy on small generated groups."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracework.operators import evaluate as ev
from tracework.operators import models as m
from tracework.operators import retrieval as ret
from tracework.operators import vectors as v


@pytest.fixture(scope="module")
def gauss(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(size=(300, 8)) @ np.diag([3, 2, 1, 1, .5, .5, .3, .2]), rng.normal(size=(20, 8)) + 6])
    pdf = pd.DataFrame({"id": range(320), "y": [0] * 300 + [1] * 20, "x": x.tolist()})
    pdf["state"] = np.where(pdf["y"] == 0, "new", "wear")
    return x, spark.createDataFrame(pdf, "id long, y int, x array<double>, state string")


REF = lambda: F.col("state") == "new"


def auc(df):
    return ev.areas(df.withColumn("g", F.lit(1)), ["g"], "y", "score").first()["roc_auc"]


def test_pca_equals_svd(gauss):
    x, df = gauss
    train = x[:300]
    z = (x - train.mean(0)) / train.std(0)
    _, s, vt = np.linalg.svd(z[:300] - z[:300].mean(0), full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2 / (s**2).sum()), 0.95, side="right")) + 1
    p = vt[:k]
    want = ((z - z @ p.T @ p) ** 2).mean(1)
    got = m.pca_reconstruction(df, "x", 8, REF()).orderBy("id").toPandas()["score"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_isolation_forest(gauss):
    _, df = gauss
    s = m.isolation_forest(df, "id", "x", REF(), trees=60)
    p = s.toPandas()["score"]
    assert p.between(0, 1).all() and auc(s) > 0.95


def test_autoencoder_learns(gauss):
    _, df = gauss
    s = m.autoencoder(df, "x", 8, REF(), epochs=10)
    assert auc(s) > 0.9


def test_auc_with_ties(spark):
    d = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 1), (1, 0.5, 0), (1, 0.1, 0), (1, 0.5, 0)], "g int, score double, y int")
    r = ev.areas(d, ["g"], "y", "score").first()
    assert abs(r["roc_auc"] - (3 + 1 + 0.5 + 0.5) / 6) < 1e-12
    assert abs(r["pr_auc"] - (0.5 * 1 + 0.5 * 0.5)) < 1e-12


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("shipped, cell, block", [(10**6, 2000, 20_000), (0, 10**6, 30), (0, 10, 4), (0, 7, 1000)])
def test_nearest_over_cells_and_blocks(spark, monkeypatch, metric, shipped, cell, block):
    for name, value in (("SHIPPED", shipped), ("CELL_ROWS", cell), ("BLOCK_ROWS", block)):
        monkeypatch.setattr(v, name, value)
    rng = np.random.default_rng(7)
    q, it = rng.normal(size=(70, 5)), rng.normal(size=(100, 5))
    frame = lambda a: spark.createDataFrame(pd.DataFrame({"id": range(len(a)), "x": a.tolist()}), "id long, x array<double>")
    got = v.nearest(frame(q), frame(it), 4, metric).orderBy("query_id", "rank").toPandas()
    if metric == "cosine":
        cost = -(q / np.linalg.norm(q, axis=1, keepdims=True)) @ (it / np.linalg.norm(it, axis=1, keepdims=True)).T
    else:
        cost = np.linalg.norm(q[:, None] - it[None], axis=2)
    want = np.argsort(cost, axis=1)[:, :4]
    np.testing.assert_array_equal(got["item_id"].to_numpy().reshape(-1, 4), want)
    np.testing.assert_allclose(got["value"].to_numpy().reshape(-1, 4), np.abs(np.take_along_axis(cost, want, 1)) if metric != "cosine" else -np.take_along_axis(cost, want, 1), atol=1e-9)


def test_nearest_holds_bounded_tables(spark, monkeypatch):
    """A task's table of distances does not grow with the items, and small tables give the same neighbours."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1000, 4)), rng.normal(size=(20_000, 4))
    tracemalloc.start()
    big = [(r, i.tolist()) for r, i, _ in v._best(x, y, np.arange(len(y)), 2, False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and [r for r, _ in big] == list(range(1000))
    frame = lambda a: spark.createDataFrame(pd.DataFrame({"id": range(len(a)), "x": a.tolist()}), "id long, x array<double>")
    monkeypatch.setattr(v, "SHIPPED", 0)
    monkeypatch.setattr(v, "CELL_ROWS", 5)
    found = lambda: v.nearest(frame(x[:40]), frame(y[:60]), 3).orderBy("query_id", "rank").collect()
    want = found()
    monkeypatch.setattr(v, "TABLE", 50)
    monkeypatch.setattr(v, "HANDED", 3)
    assert found() == want


def test_bm25_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(60)], "id long, text string")
    qs = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(5)], "id long, text string")
    one = ret.bm25(docs, qs, 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ret, "QUERY_TOKENS", 6)
    monkeypatch.setattr(ret, "DOC_BLOCK", 7)
    monkeypatch.setattr(ret, "HELD_TERMS", 5)
    assert ret.bm25(docs, qs, 5).orderBy("query_id", "rank").collect() == one
    assert len(one) == 25 and ret.bm25(docs.limit(0), qs, 5).count() == 0 and ret.bm25(docs, qs.limit(0), 5).count() == 0


def test_pivot_bounds_rule_out_most_cells(spark, monkeypatch):
    """Clustered vectors: exact neighbours while a query visits less than a fifth of the items, also with ties and null vectors."""
    monkeypatch.setattr(v, "SHIPPED", 0)
    monkeypatch.setattr(v, "CELL_ROWS", 60)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 12)) * 4
    it = np.concatenate([c + rng.normal(size=(75, 12)) * 0.4 for c in centre])
    it[10:14] = it[10]
    q = np.concatenate([it[::60] + 0.01, rng.normal(size=(5, 12)) * 4, it[10:11]])
    frame = lambda a: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)] + [(10**6, None)], "id long, x array<double>")
    items, queries = frame(it), frame(q)
    got = v.nearest(queries, items, 5).orderBy("query_id", "rank").toPandas()
    d = np.round(np.linalg.norm(q[:, None] - it[None], axis=2), 12)
    want = np.array([np.lexsort((np.arange(len(it)), row))[:5] for row in d])
    np.testing.assert_array_equal(got["item_id"].to_numpy().reshape(-1, 5), want)
    real = queries.where("x is not null")
    cells = v.Cells(items.where("x is not null"), len(it), False)
    bound = spark.createDataFrame([(i, float(b)) for i, b in enumerate(np.sort(d, 1)[:, 4])], "id long, bound double")
    size = dict(enumerate(cells.count.tolist()))
    looked = sum(size[r["cell"]] for part in (v.visits(real, cells, 5), v.visits(real, cells, 5, bound)) for r in part.select("cell").collect())
    assert looked < 0.2 * len(q) * len(it)


def test_zero_vectors_in_cosine_search(spark, monkeypatch):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, -2.0]), (3, [-3.0, 0.0])], "id long, x array<double>")
    out = []
    for shipped in (0, 10**6):
        monkeypatch.setattr(v, "SHIPPED", shipped)
        monkeypatch.setattr(v, "CELL_ROWS", 1)
        out.append(sorted(map(tuple, v.nearest(rows, rows, 2, "cosine").collect())))
    assert out[0] == out[1] and [r[:3] for r in out[0] if r[0] == 0] == [(0, 0, 0.0), (0, 1, 0.0)]


def test_split_shares(spark):
    d = spark.range(200).withColumn("c", F.when(F.col("id") < 60, "a").otherwise("b"))
    c = {(r["c"], r["split"]): r["count"] for r in m.split(d, "id", {"train": 0.7, "test": 0.3}, "c").groupBy("c", "split").count().collect()}
    assert c == {("a", "train"): 42, ("a", "test"): 18, ("b", "train"): 98, ("b", "test"): 42}


def test_smote_lies_between(gauss):
    x, df = gauss
    s = m.smote(df, "id", "x", "y", 1, 2).toPandas()
    assert len(s) == 40
    lo, hi = x[300:].min(0) - 1e-9, x[300:].max(0) + 1e-9
    a = np.stack(s["x"])
    assert ((a >= lo) & (a <= hi)).all()


def test_forest_fits_do_not_depend_on_the_splits_of_the_input(spark, monkeypatch):
    """A small table is fitted in one part however its files are cut (every part shuffles all nodes of a level); a larger one in even parts."""
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.random() < 0.5), 1.0, rng.normal(size=4).tolist()) for i in range(160)]
    made = spark.createDataFrame(rows, "id long, label double, weight double, x array<double>").select("id", "label", "weight", array_to_vector("x").alias("features"))
    assert made.rdd.getNumPartitions() == 8
    cut, whole = (sorted(map(tuple, m.cross_val(d, "id", 8, trees=3, depth=2).collect())) for d in (made, made.coalesce(1)))
    assert cut == whole
    monkeypatch.setattr(m, "TASK_ROWS", 60)
    dealt, fits = m._gathered(made, 8)
    sizes = sorted(len(p) for p in dealt.rdd.glom().collect())
    assert len(sizes) == 3 and sum(sizes) == 160 and sizes[0] > 40 and sizes[-1] <= 60 and fits >= m.PARALLEL
    dealt.unpersist()
    dealt, fits = m._gathered(made, 2)
    assert dealt.rdd.getNumPartitions() == 4  # two models alone have to use eight cores
    dealt.unpersist()


def test_ablation_fits_subsets_at_a_time_and_scores_a_row_once(spark):
    from threading import Barrier
    d = spark.createDataFrame([(i, i % 3 == 0, "new" if i % 3 else "wear", float(i), None if i == 5 else float(-i)) for i in range(30)], "id int, y boolean, state string, a double, b double")
    d = d.withColumn("y", F.col("y").cast("int"))
    seen, both = spark.sparkContext.accumulator(0), Barrier(2)

    def score(df, cols):
        both.wait(60)  # breaks unless both subsets are under way

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            seen.add(len(s))
            return s * 2

        return df.withColumn("score", run(F.col(cols[0])))

    got = {r["experiment"]: r.asDict() for r in ev.ablation(d, {"first": ["a"], "second": ["b"]}, {"a": ["a"], "b": ["b"]}, score, "state", "y", "new", "wear").collect()}
    assert seen.value == 60 and set(got) == {"first", "second"}
    new, wear = [float(i) for i in range(30) if i % 3], [float(i) for i in range(30) if i % 3 == 0]
    assert got["first"]["ref_mean"] == pytest.approx(2 * np.mean(new)) and got["first"]["test_mean"] == pytest.approx(2 * np.mean(wear))
    assert got["second"]["ref_mean"] == pytest.approx(-2 * np.mean([v for v in new if v != 5])) and got["second"]["features"] == 1
    assert got["first"]["roc_auc"] == pytest.approx(np.mean([(w > n) + 0.5 * (w == n) for w in wear for n in new]))


def test_decompositions_take_turns(spark):
    """Spark's own decomposition, run by several threads, fails to converge or gives wrong components."""
    from multiprocessing.pool import ThreadPool
    import pickle
    from tracework.operators import estimators as e
    rng = np.random.default_rng(12)
    d = spark.createDataFrame([(rng.normal(size=16).tolist(),) for _ in range(200)], "x array<double>").cache()
    one = lambda _: e.PcaReconstruction(share=0.5).fit(d).arrays["components"]
    want = one(0)
    with ThreadPool(8) as pool:
        assert all(np.abs(c - want).max() < 1e-6 for c in pool.map(one, range(32)))
    assert pickle.loads(pickle.dumps(e.DECOMPOSING)).lock.acquire(blocking=False)


def test_grid_search_holds_few_nodes_on_the_driver(spark, monkeypatch):
    """The folds and forests of Spark's cross-validation while a forest is small; a larger one is grown in shares whose votes are summed."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rng = np.random.default_rng(13)
    x = rng.normal(size=(150, 4))
    rows = [(i, float(v[0] + v[1] + rng.normal() > 0), 1.0, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows + rows[:3], "id long, label double, weight double, x array<double>").select("id", "label", "weight", array_to_vector("x").alias("features")).coalesce(1).cache()
    rf = m.forest_classifier()
    grid = ParamGridBuilder().addGrid(rf.numTrees, (5, 7)).addGrid(rf.maxDepth, (3,)).addGrid(rf.minInstancesPerNode, (2,)).build()
    want = CrossValidator(estimator=rf, estimatorParamMaps=grid, numFolds=2, seed=42, evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")).fit(m._gathered(d, 4)[0]).avgMetrics
    search = lambda: m.grid_search(d, (5, 7), (3,), (2,), 2).orderBy("trees").collect()
    assert [r["accuracy"] for r in search()] == want
    sizes, fit = [], m.RandomForestClassifier._fit
    monkeypatch.setattr(m.RandomForestClassifier, "_fit", lambda self, df: sizes.append(self.getNumTrees()) or fit(self, df))
    monkeypatch.setattr(m, "NODES", 1)
    few = search()
    assert sorted(sizes) == sorted(2 * [2, 3, 2, 2, 3]) and [r["trees"] for r in few] == [5, 7] and sum(r["best"] for r in few) >= 1
    # the votes of the shares, by hand
    train, test = d.where("id % 2 = 0").cache(), d.where("id % 2 = 1").withColumn("_row", F.monotonically_increasing_id()).cache()
    got = m._forest_accuracy(train, test, 76, 1, 5, 3, 2, 42)
    models = [m.forest_classifier(trees=n, depth=3, min_rows=2, seed=42 + i).fit(train) for i, n in enumerate((2, 3))]
    votes = sum(np.stack([r["rawPrediction"].toArray() for r in f.transform(test).orderBy("id").collect()]) for f in models)
    assert got == pytest.approx(np.mean(votes.argmax(1) == [r["label"] for r in test.orderBy("id").collect()]))
