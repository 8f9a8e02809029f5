"""Anomaly and classification models fitted as Spark jobs."""
from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.operators.estimators import PCA_SHARE, SUBSAMPLE, TREES, AutoEncoder, IsolationForest, KernelFeatures, PcaReconstruction
from tracework.operators.ordered import ordered_columns
from tracework.operators.quality import hash_order
from tracework.session import materialise, scratch

# The settings of the reference experiments (a depth without limit is Spark's greatest, 30)
GRID_TREES, GRID_DEPTHS, GRID_ROWS, FOLDS = (100, 200, 300), (30, 10, 20), (2, 5, 10), 5
SHARES, CURVE_TREES = tuple(i / 10 for i in range(1, 11)), (10, 50, 100, 200)
#: Models fitted at a time, at least.
PARALLEL = 4
#: Rows of a table that one task of a forest fit keeps, with one weight per tree.
TASK_ROWS = 100_000
#: Nodes that all fits of a grid search have on the driver at a time, about 500 bytes each while a forest grows.
NODES = 400_000
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


# --- preparation -----------------------------------------------------------------------------

def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the column mean (one scalar row)."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    df = df.withColumn("_m", means)
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"_m.{c}")) for c in cols}).drop("_m")


def split(df: DataFrame, id_col: str, parts: dict[str, float], stratify: str | None = None, seed: int = 42) -> DataFrame:
    """Deterministic split by hash order, exact shares per stratum, column ``split``."""
    keys = [stratify] if stratify else []
    h = F.conv(F.substring(hash_order(id_col, seed), 1, 12), 16, 10).cast("double")
    d = ordered_columns(df.withColumn("_h", h), keys, ["_h", id_col], index="_i", total={"_n": ("count", F.lit(1))})
    share, edge, expr = (F.col("_i") + 0.5) / F.col("_n"), 0.0, None
    names = list(parts)
    for name in names[:-1]:
        edge += parts[name]
        expr = F.when(share < edge, name) if expr is None else expr.when(share < edge, name)
    return d.withColumn("split", expr.otherwise(names[-1]) if expr is not None else F.lit(names[-1])).drop("_h", "_i", "_n")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    t = c.agg(F.struct(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    w = c.withColumn("_t", t).select(label, (F.col("_t.n") / (F.col("_t.k") * F.col("_c"))).alias(out))
    return df.join(w, label)


# --- anomaly scores --------------------------------------------------------------------------

def scale_arrays(df: DataFrame, x: str, ref: Column, out: str = "z", floor: float = 1e-12) -> DataFrame:
    """Standardise array elements with mean and population std of the reference rows."""
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(x)))
    stats = df.where(ref).select(s.alias("s")).select(F.struct(
        F.col("s.count").alias("n"), vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))).scalar()
    d = df.withColumn("_s", stats)
    ratio = (F.col("_s.n") - 1) / F.col("_s.n")
    scale = F.zip_with("_s.m", "_s.v", lambda m, v: F.struct(m.alias("m"), F.greatest(F.sqrt(v * ratio), F.lit(floor)).alias("d")))
    return d.withColumn(out, F.zip_with(x, scale, lambda v, p: (v - p["m"]) / p["d"])).drop("_s")


def pca_fit(df: DataFrame, x: str, dims: int, ref: Column, share: float = PCA_SHARE):
    """Standardise on the reference rows and fit all components there: (scaled frame, model, k)."""
    z = scale_arrays(df, x, ref).withColumn("features", array_to_vector("z"))
    model = PCA(k=dims, inputCol="features", outputCol="pc").fit(z.where(ref).select("features"))
    cum = np.cumsum(model.explainedVariance.toArray())
    return z, model, min(dims, int(np.searchsorted(cum, share, side="right")) + 1)


def pca_reconstruction(df: DataFrame, x: str, dims: int, ref: Column, share: float = PCA_SHARE) -> DataFrame:
    """Mean squared reconstruction error with the components that explain ``share`` of the variance of the reference rows."""
    return PcaReconstruction(inputCol=x, share=share).fit(df.where(ref)).transform(df)


def pca_2d(df: DataFrame, x: str, dims: int, ref: Column) -> DataFrame:
    z, model, _ = pca_fit(df, x, dims, ref)
    a = vector_to_array("pc")
    return model.transform(z).withColumn("pc1", a[0]).withColumn("pc2", a[1]).drop("features", "pc", "z")


def _expected_depth(n):
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, h, np.where(n == 2, 1.0, 0.0))


def forest(df: DataFrame, id_col: str, x: str, trees: int = TREES, sample: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """Isolation trees, one row per node; every tree sees at most ``sample`` hash-chosen rows.

    A pre-filter keeps about ``8 * sample`` candidate rows per tree before they are ranked, so
    the exploded table stays bounded whatever the size of the training set.
    """
    n = df.count()
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    draw = F.pmod(F.xxhash64(id_col, "tree", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    d = df.select(id_col, x).withColumn("tree", tree).withColumn("_u", draw)
    d = d.where(F.col("_u") < min(1.0, 8.0 * sample / max(n, 1)))
    from tracework.operators.windows import top_k

    chosen = top_k(d.withColumn("_d", -F.col("_u")), "_d", sample, id_col, ["tree"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        data = np.stack(pdf.sort_values("rank")[x].to_numpy())
        limit = int(np.ceil(np.log2(max(len(data), 2))))
        nodes, stack = [], [(0, np.arange(len(data)), 0)]
        # children of node i are numbered 2i+1 and 2i+2
        while stack:
            i, rows, depth = stack.pop()
            lo, hi = (data[rows].min(0), data[rows].max(0)) if len(rows) else (None, None)
            open_cols = np.flatnonzero(hi > lo) if len(rows) > 1 and depth < limit else []
            if len(open_cols) == 0:
                nodes.append((t, i, -1, 0.0, depth + float(_expected_depth(len(rows)))))
                continue
            c = int(rng.choice(open_cols))
            cut = float(rng.uniform(lo[c], hi[c]))
            left = data[rows, c] < cut
            nodes.append((t, i, c, cut, 0.0))
            stack += [(2 * i + 1, rows[left], depth + 1), (2 * i + 2, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "path"])

    return chosen.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, path double")


def isolation_forest(df: DataFrame, id_col: str, x: str, ref: Column, trees: int = TREES, seed: int = 42) -> DataFrame:
    return IsolationForest(inputCol=x, idCol=id_col, trees=trees, seed=seed).fit(df.where(ref)).transform(df)


def autoencoder(df: DataFrame, x: str, dims: int, ref: Column, epochs: int = 120, lr: float = 1e-3, seed: int = 42) -> DataFrame:
    """Reconstruction error of a 64-32-8-32-64 network trained on the reference rows."""
    return AutoEncoder(inputCol=x, epochs=epochs, rate=lr, seed=seed).fit(df.where(ref)).transform(df)


# --- classifiers -----------------------------------------------------------------------------

def forest_classifier(label: str = "label", trees: int = 100, depth: int = 10, min_rows: int = 1, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees,
                                  maxDepth=depth, minInstancesPerNode=min_rows, seed=seed)


def forest_summary(model, cols: Sequence[str], spark) -> DataFrame:
    """Importance per feature, with node count and greatest depth of the forest."""
    depth = max(t.depth for t in model.trees)
    rows = [(c, float(i), int(model.totalNumNodes), int(depth)) for c, i in zip(cols, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double, nodes long, depth int")


def _gathered(df: DataFrame, models: int) -> tuple[DataFrame, int]:
    """``df``, kept, in no more even parts than its rows or the cores need for so many models, and the number of models to fit at a time.

    Every part of a forest fit hands on the statistics of all nodes of a level, however few rows it has, so what a fit shuffles grows with its
    parts; and a join on the label may have left all rows in one part per label. More fits at a time use the cores instead.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-df.count() // TASK_ROWS), -(-cores // models))
    d = df.coalesce(1) if parts == 1 else df.repartition(parts)
    return d.persist(), max(PARALLEL, cores // parts + 1)


def _forest_accuracy(train: DataFrame, test: DataFrame, rows: int, most: int, trees: int, depth: int, min_rows: int, seed: int) -> float:
    """Accuracy on ``test`` of a forest fitted on the ``rows`` rows of ``train``, of which the driver holds about ``most`` nodes at a time.

    A larger forest is grown in shares with seeds of their own, whose votes are written down for every row (``_row``) and summed: what a forest
    says is the sum of what its trees say.
    """
    nodes = 2 * min(1 << depth, max(1, rows // min_rows))
    shares = min(-(-trees // max(1, most // nodes)), max(1, trees // 2))  # of two trees at least: Spark takes all features for a single one
    rf = forest_classifier(depth=depth, min_rows=min_rows).setCacheNodeIds(True)  # else every level ships all nodes above it
    votes = None
    with scratch():
        for i in range(shares):
            model = rf.copy({rf.numTrees: trees * (i + 1) // shares - trees * i // shares, rf.seed: seed + i}).fit(train)
            if shares == 1:
                return MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(model.transform(test))
            part = materialise(model.transform(test).select("_row", "label", F.posexplode(vector_to_array("rawPrediction")).alias("class", "votes")), "votes")
            votes = part if votes is None else votes.unionByName(part)
        each = votes.groupBy("_row", "label", "class").agg(F.sum("votes").alias("votes"))
        # most votes, the first class of equal ones
        said = each.groupBy("_row", "label").agg(F.max(F.struct("votes", (-F.col("class")).alias("class"))).alias("best"))
        return _accuracy(said.select("label", (-F.col("best.class")).cast("double").alias("prediction")))


def grid_search(df: DataFrame, trees: Sequence[int] = GRID_TREES, depths: Sequence[int] = GRID_DEPTHS, min_rows: Sequence[int] = GRID_ROWS, folds: int = FOLDS,
                seed: int = 42) -> DataFrame:
    """Cross-validated accuracy for every combination."""
    rf = forest_classifier(seed=seed)
    grid = ParamGridBuilder().addGrid(rf.numTrees, trees).addGrid(rf.maxDepth, depths).addGrid(rf.minInstancesPerNode, min_rows).build()
    d, fits = _gathered(df, len(grid) * folds)
    # the folds of Spark's cross-validation
    pairs = CrossValidator(estimator=rf, estimatorParamMaps=grid, numFolds=folds, seed=seed)._kFold(d)
    pairs = [(train, materialise(test.withColumn("_row", F.monotonically_increasing_id()), "fold"), train.count()) for train, test in pairs]

    def one(task: tuple[int, int]) -> float:
        (train, test, rows), p = pairs[task[0]], grid[task[1]]
        return _forest_accuracy(train, test, rows, NODES // fits, p[rf.numTrees], p[rf.maxDepth], p[rf.minInstancesPerNode], seed)

    found = np.array(_at_once(df, one, [(f, i) for f in range(folds) for i in range(len(grid))], fits)).reshape(folds, len(grid)).mean(axis=0)
    d.unpersist()
    rows = [(p[rf.numTrees], p[rf.maxDepth], p[rf.minInstancesPerNode], float(a), bool(a == found.max())) for p, a in zip(grid, found)]
    return df.sparkSession.createDataFrame(rows, "trees int, depth int, min_rows int, accuracy double, best boolean")


def _accuracy(pred: DataFrame) -> float:
    return float(pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])


def folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(k)).cast("int"))


def _at_once(df: DataFrame, work, tasks: Sequence, fits: int) -> list:
    """Fit several models at a time; each fit is a chain of small jobs that leaves most cores idle."""
    with ThreadPool(fits) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), tasks)


def cross_val(df: DataFrame, id_col: str, k: int = FOLDS, **params) -> DataFrame:
    d, fits = _gathered(folds(df, id_col, k), k)

    def one(i: int):
        model = forest_classifier(**params).fit(d.where(F.col("fold") != i))
        return i, _accuracy(model.transform(d.where(F.col("fold") == i)))

    rows = _at_once(df, one, range(k), fits)
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def learning_curve(df: DataFrame, id_col: str, shares: Sequence[float] = SHARES, k: int = FOLDS, **params) -> DataFrame:
    """Mean and deviation over ``k`` folds of train and test accuracy, for growing parts of the training folds (chosen by hash)."""
    d, fits = _gathered(folds(df, id_col, k).withColumn("_u", F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 20)) / float(1 << 20)), len(shares) * k)

    def one(task: tuple[float, int]):
        share, i = task
        part, test = d.where((F.col("fold") != i) & (F.col("_u") < share)), d.where(F.col("fold") == i)
        model = forest_classifier(**params).fit(part)
        return float(share), i, part.count(), _accuracy(model.transform(part)), _accuracy(model.transform(test))

    rows = _at_once(df, one, [(s, i) for s in shares for i in range(k)], fits)
    d.unpersist()
    each = df.sparkSession.createDataFrame(rows, "share double, fold int, rows long, train double, test double")
    return each.groupBy("share").agg(F.avg("rows").alias("rows"), F.avg("train").alias("train_accuracy"), F.stddev_pop("train").alias("train_std"),
                                     F.avg("test").alias("test_accuracy"), F.stddev_pop("test").alias("test_std"))


def validation_curve(df: DataFrame, id_col: str, trees: Sequence[int] = CURVE_TREES, k: int = FOLDS, **params) -> DataFrame:
    """Mean and deviation over ``k`` folds of train and test accuracy by number of trees."""
    d, fits = _gathered(folds(df, id_col, k), len(trees) * k)

    def one(task: tuple[int, int]):
        n, i = task
        pool, test = d.where(F.col("fold") != i), d.where(F.col("fold") == i)
        model = forest_classifier(trees=n, **params).fit(pool)
        return n, i, _accuracy(model.transform(pool)), _accuracy(model.transform(test))

    rows = _at_once(df, one, [(n, i) for n in trees for i in range(k)], fits)
    d.unpersist()
    each = df.sparkSession.createDataFrame(rows, "trees int, fold int, train double, test double")
    return each.groupBy("trees").agg(F.avg("train").alias("train_accuracy"), F.stddev_pop("train").alias("train_std"), F.avg("test").alias("test_accuracy"), F.stddev_pop("test").alias("test_std"))


def svm_pipeline(kernel: str = "linear", reg: float = 0.01, iters: int = 50, width: int = 1024, seed: int = 42) -> Pipeline:
    """Support vector classifier on ``features``, ``label`` and ``weight``: scaling, kernel features (rbf, or poly of degree 3 over all values) and
    a linear machine.  One pipeline, so what ``fit`` returns can be saved, loaded and applied to new rows."""
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]
    if kernel != "linear":
        stages.append(KernelFeatures(inputCol="scaled", outputCol="expanded", kernel=kernel, width=width, seed=seed))
    return Pipeline(stages=[*stages, LinearSVC(featuresCol="scaled" if kernel == "linear" else "expanded", labelCol="label", weightCol="weight", regParam=reg, maxIter=iters)])


def svm(train: DataFrame, test: DataFrame, kernel: str = "linear", **params) -> DataFrame:
    """``test`` with the predictions of a machine fitted on ``train``."""
    return svm_pipeline(kernel, **params).fit(train).transform(test)


def smote(df: DataFrame, id_col: str, x: str, label: str, minority: int, copies: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows, each a uniform share of the way from a row to one of its k nearest minority rows.

    Copies go through the neighbours in a seeded order, again and again if there are more copies than neighbours.
    """
    from tracework.operators.vectors import nearest

    part = df.where(F.col(label) == minority).select(F.col(id_col).alias("id"), F.col(x).alias("x"))
    near = nearest(part, part, k + 1).where(F.col("query_id") != F.col("item_id"))
    draw = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    # at most k neighbours a row: the window is small
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(draw("query_id", "item_id", F.lit("neighbour")), "item_id"))
    turns = near.withColumn("_r", order).withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    pick = turns.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(copies)))).where((F.col("rank") - 1) % F.col("_n") + 1 == F.col("_r"))
    pick = pick.withColumn("_u", draw("query_id", "item_id", "rank", F.lit("share")))
    a = part.select(F.col("id").alias("query_id"), F.col("x").alias("_a"))
    b = part.select(F.col("id").alias("item_id"), F.col("x").alias("_b"))
    j = pick.join(a, "query_id").join(b, "item_id")
    mix = F.zip_with("_a", "_b", lambda p, q: (p + (q - p) * F.col("_u")).cast("double"))
    return j.select(F.col("query_id").alias(id_col), F.col("rank").alias("copy"), F.lit(minority).alias(label), mix.alias(x))


def encode_table(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Number columns for any table: (``df`` with them, their names).  Statistics come from ``train``; no row is left out.

    Numbers keep their value, or the mean of ``train`` where it is missing or not finite.  A string of any number of categories becomes
    the logarithm of its frequency in ``train`` (0 if unseen) and a position that its hash gives it; both by joins, nothing is collected.
    Every column has an indicator of missing values.
    """
    types, names = dict(df.dtypes), []
    numbers = [c for c in cols if types[c] in NUMBERS or types[c].startswith("decimal")]
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))  # noqa: E731 - null, NaN and infinite values are missing
    means = train.agg(F.struct(F.lit(0).alias("_"), *[F.avg(number(c)).alias(c) for c in numbers])).scalar()
    out = df.withColumn("_means", means)
    for c in cols:
        if c in numbers:
            out = out.withColumn(f"{c}_n", F.coalesce(number(c), F.col("_means")[c], F.lit(0.0))).withColumn(f"{c}_missing", number(c).isNull().cast("double"))
            names += [f"{c}_n", f"{c}_missing"]
        elif types[c] == "string":
            counts = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_category")).agg(F.log(F.count(F.lit(1)) + 1.0).alias(f"{c}_often"))
            out = out.join(counts, F.col(c) == F.col("_category"), "left").drop("_category").withColumn(f"{c}_often", F.coalesce(f"{c}_often", F.lit(0.0)))
            out = out.withColumn(f"{c}_place", F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)).withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
            names += [f"{c}_often", f"{c}_place", f"{c}_missing"]
    return out.drop("_means"), names


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows, in parts that a task can keep: a file of few, well compressed columns may hold millions of rows."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def auto_evaluate(df: DataFrame, target: str, id_col: str, regression: bool, seed: int = 42, trees: int = 100) -> DataFrame:
    """Random forest on any table: 80/20 split, accuracy or R2 and MSE, and the rows used.

    All rows with a target take part, whatever is missing in their other columns and however many categories those have.
    """
    test = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(100)) >= 80
    rows = df.where(F.col(target).isNotNull()).withColumn("_test", test)
    coded, names = encode_table(rows.where("not _test"), rows, [c for c in df.columns if c not in (target, id_col)])
    stages = [VectorAssembler(inputCols=names, outputCol="features")]
    if regression:
        coded = coded.withColumn("label", F.col(target).cast("double"))
    else:
        stages.insert(0, StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep"))
    model_cls = RandomForestRegressor if regression else RandomForestClassifier
    # the columns of the forest alone, read again for each pass: kept, they would take several times the disk of the table
    coded = coded.select("_test", *(["label"] if regression else [target]), *names)
    counts = {r["_test"]: r["count"] for r in rows.groupBy("_test").count().collect()}
    model = Pipeline(stages=[*stages, model_cls(labelCol="label", featuresCol="features", numTrees=trees, seed=seed)]).fit(_dealt(coded, sum(counts.values())).where("not _test"))
    pred = model.transform(coded.where("_test"))
    ev = (lambda m: RegressionEvaluator(metricName=m).evaluate(pred)) if regression else (
        lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(pred))
    found = [(m, float(ev(m))) for m in (("r2", "mse") if regression else ("accuracy",))]
    found += [("train_rows", float(counts.get(False, 0))), ("test_rows", float(counts.get(True, 0)))]
    return df.sparkSession.createDataFrame(found, "metric string, value double")
