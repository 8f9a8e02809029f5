"""Model evaluation as aggregations: curves, areas, reports, comparison and fusion."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.operators.aggregates import long_features
from tracework.operators.ordered import ordered_columns
from tracework.session import materialise


def score_steps(df: DataFrame, keys: Sequence[str], y: str, score: str, counted: Mapping[str, Column] | None = None) -> DataFrame:
    """Cumulative counts at every distinct score, highest first: pos, neg, tp, fp, all_pos, all_neg; and of rows for which a condition of ``counted`` holds.

    Rows are first counted per distinct score, so ties share a step and the running
    sums run over value ranges, not over one sorted task.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"), *[F.count_if(c).alias(out) for out, c in (counted or {}).items()])
    counts = counts.withColumn("_down", -F.col("score"))
    return ordered_columns(
        counts, keys, ["_down"], running={"tp": "pos", "fp": "neg"},
        total={"all_pos": ("sum", F.col("pos")), "all_neg": ("sum", F.col("neg"))}).drop("_down")


def _areas():
    pairs = F.col("all_pos") * F.col("all_neg")
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)) / F.max(F.when(pairs > 0, pairs))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max(F.when(F.col("all_pos") > 0, F.col("all_pos")))
    return auc.alias("roc_auc"), ap.alias("pr_auc")


def areas(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Rank area under the ROC curve (ties count half) and average precision per key."""
    steps = score_steps(df, keys, y, score)
    return steps.groupBy(*keys).agg(*_areas())


def roc_curve(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    s = score_steps(df, keys, y, score)
    return s.select(*keys, F.col("score").alias("threshold"), (F.col("fp") / F.col("all_neg")).alias("fpr"),
                    (F.col("tp") / F.col("all_pos")).alias("tpr"))


def pr_curve(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    s = score_steps(df, keys, y, score)
    return s.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("all_pos")).alias("recall"))


def compare(df: DataFrame, state: str, label: str, scores: Sequence[str], ref: str, test: str) -> DataFrame:
    """One row per score column: areas, mean score per state and their difference, in one pass."""
    m = long_features(df, [state, label], scores).withColumnRenamed("feature", "method")
    means = m.groupBy("method").agg(F.avg(F.when(F.col(state) == ref, F.col("value"))).alias("ref_mean"),
                                    F.avg(F.when(F.col(state) == test, F.col("value"))).alias("test_mean"))
    return areas(m, ["method"], label, "value").join(means, "method").withColumn(
        "difference", F.col("test_mean") - F.col("ref_mean"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, pred: str, zero_division: float = 0.0) -> DataFrame:
    """precision, recall, f1 and support per class plus accuracy, macro and weighted rows."""
    cells = confusion(df, y, pred)
    both = cells.select(F.explode(F.array(
        F.struct(F.col(y).cast("string").alias("c"), F.lit(0).alias("role"), F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n")),
        F.struct(F.col(pred).cast("string").alias("c"), F.lit(1).alias("role"), F.lit(0).cast("long").alias("tp"), F.col("n")))).alias("r")).select("r.*")
    g = both.groupBy(F.col("c").alias("class")).agg(
        F.sum("tp").alias("tp"), F.sum(F.when(F.col("role") == 0, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("role") == 1, F.col("n")).otherwise(0)).alias("predicted"))
    div = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(zero_division))
    g = g.withColumn("precision", div(F.col("tp"), F.col("predicted"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    pr = F.col("precision") + F.col("recall")
    g = g.withColumn("f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / F.when(pr > 0, pr)).otherwise(F.lit(zero_division)))
    cols = ["class", "precision", "recall", "f1", "support"]
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    acc = F.sum("tp") / F.sum("support")
    summary = g.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.sum("support").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"), F.sum("support").alias("support")),
    ).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return g.select(*cols).unionByName(summary)


def threshold(df: DataFrame, prob: str, cut: float, inclusive: bool, out: str = "pred") -> DataFrame:
    hit = F.col(prob) >= cut if inclusive else F.col(prob) > cut
    return df.withColumn(out, F.when(hit, 1).otherwise(0))


def false_positives(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.where((F.col(y) == 0) & (F.col(pred) == 1))


def fuse(df: DataFrame, force: str = "force_z", punch: str = "punch_z", sheet: str = "sheet_z") -> DataFrame:
    """Single, pairwise and triple score fusion by means of z-scores."""
    f, p, s = F.col(force), F.col(punch), F.col(sheet)
    return df.withColumns({
        "force_only": f, "punch_only": p, "sheet_only": s, "force_plus_sheet": (f + s) / 2, "force_plus_punch": (f + p) / 2,
        "punch_plus_sheet": (p + s) / 2, "force_plus_punch_plus_sheet": (f + p + s) / 3})


def ablation(features: DataFrame, experiments: Mapping[str, Sequence[str]], columns_of: Mapping[str, Sequence[str]],
             score, state: str, label: str, ref: str, test: str, scores: Sequence[str] = ("score",)) -> DataFrame:
    """Run ``score(df, columns) -> df with the columns scores`` (one per model) per channel subset and compare all of them."""
    def one(experiment: tuple[str, Sequence[str]]) -> DataFrame:
        name, channels = experiment
        cols = [c for ch in channels for c in columns_of[ch]]
        # written down: filters on a score, and the explode, would score the rows again
        scored = materialise(score(features, cols).select(state, label, *[F.col(s).cast("double").alias(s) for s in scores]), "scored")
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in scores]))
        return scored.select(state, label, F.lit(name).alias("experiment"), F.lit(len(cols)).alias("features"), each.alias("_e")).select("*", "_e.*").drop("_e")

    # a fit is a chain of small jobs that leaves most cores idle
    spark = features.sparkSession
    with ThreadPool(max(1, min(len(experiments), spark.sparkContext.defaultParallelism))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(one), experiments.items(), chunksize=1)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keys = ["experiment", "features", "model"]
    # means and areas from the same counts
    steps = score_steps(rows, keys, label, "score", {"_ref": F.col(state) == ref, "_test": F.col(state) == test})
    mean = lambda n: F.sum(F.when(F.col(n) > 0, F.col("score") * F.col(n))) / F.sum(F.when(F.col(n) > 0, F.col(n)))
    return steps.groupBy(*keys).agg(*_areas(), mean("_ref").alias("ref_mean"), mean("_test").alias("test_mean"))
