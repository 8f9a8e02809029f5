"""Models on the embedding table (label 0 is the good state) and on the star schema."""
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracework.operators import evaluate as ev
from tracework.operators import models as m
from tracework.operators import vectors as v
from tracework.plans.registry import outputs, query

DIMS = [f"e{i}" for i in range(64)]


def states(t):
    """Vectors as double arrays with state and binary label."""
    return t.embeddings.select(
        "vec_id", F.when(F.col("label") == 0, "new").otherwise("wear").alias("state"), (F.col("label") != 0).cast("int").alias("y"),
        F.transform("embedding", lambda c: c.cast("double")).alias("x"))


def labelled(t):
    """features vector, double label (digit below 5) and balanced weights."""
    d = t.embeddings.select("vec_id", (F.col("label") < 5).cast("double").alias("label"),
                            array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return m.class_weights(d, "label")




def _ref():
    return F.col("state") == "new"


@query("ml_pca_recon")
def _(t):
    return outputs(m.pca_reconstruction(states(t), "x", 64, _ref()).select("vec_id", "state", "score"))


@query("vec_pca_2d")
def _(t):
    return outputs(m.pca_2d(states(t), "x", 64, _ref()).select("vec_id", "state", "pc1", "pc2"))


@query("ml_isolation_forest")
def _(t):
    return outputs(m.isolation_forest(states(t), "vec_id", "x", _ref()).select("vec_id", "state", "score"))


@query("ml_autoencoder")
def _(t):
    return outputs(m.autoencoder(states(t), "x", 64, _ref()).select("vec_id", "state", "score"))


@query("ml_random_forest")
def _(t):
    d = labelled(t)
    model = m.forest_classifier().fit(d)
    return outputs(m.forest_summary(model, DIMS, t.spark))


@query("ml_grid_search")
def _(t):
    return outputs(m.grid_search(labelled(t)))


@query("ml_cross_val")
def _(t):
    return outputs(m.cross_val(labelled(t), "vec_id"))


@query("ml_learning_curve")
def _(t):
    return outputs(m.learning_curve(labelled(t), "vec_id"))


@query("ml_validation_curve")
def _(t):
    return outputs(m.validation_curve(labelled(t), "vec_id"))


for _kernel in ("linear", "rbf", "poly"):
    def _make(kernel):
        @query("ml_svm" if kernel == "linear" else f"ml_svm_{kernel}")
        def _(t):
            """Fitted on four fifths of the vectors, applied to the others."""
            d = m.folds(labelled(t), "vec_id")
            return m.svm(d.where("fold <> 0"), d.where("fold = 0"), kernel).select("vec_id", "label", "prediction")
    _make(_kernel)


@query("ml_smote")
def _(t):
    x = F.transform("embedding", lambda e: e.cast("double"))
    d = t.embeddings.select("vec_id", (F.col("label") == 0).cast("int").alias("minor"), x.alias("x"))
    s = m.smote(d, "vec_id", "x", "minor", 1, 3)
    return s.select("vec_id", "copy", F.posexplode("x").alias("k", "x")).groupBy("vec_id", "copy").agg(F.round(F.sum("x"), 6).alias("total"))


def _scores(d, x, size):
    """The vectors with all three model scores of one array column."""
    scored = m.pca_reconstruction(d, x, size, _ref()).withColumnRenamed("score", "pca")
    scored = m.isolation_forest(scored, "vec_id", x, _ref()).withColumnRenamed("score", "isolation")
    return m.autoencoder(scored, x, size, _ref()).withColumnRenamed("score", "autoencoder")


@query("ev_ablation")
def _(t):
    """Eight channel subsets (blocks of 16 positions), all three models each, one comparison table."""
    ch = {f"ch{c}": list(range(c * 16, (c + 1) * 16)) for c in range(4)}
    names = list(ch)
    subsets = {"all": names, "without_last": names[:3], "front": names[:2], "back": names[2:], **{n: [n] for n in names}}
    models = ["pca", "isolation", "autoencoder"]

    def score(d, positions):
        return _scores(d.withColumn("part", F.array(*[F.col("x")[p] for p in positions])), "part", len(positions))

    return outputs(ev.ablation(states(t), subsets, ch, score, "state", "y", "new", "wear", models))


@query("ev_robustness_grid")
def _(t):
    """Four crops of the vector and its histogram, three scores each, one comparison per combination."""
    crops = {"full": (1, 64), "centre_0.65": (12, 42), "large_centre_0.85": (6, 54), "fixed_random_0.65": (18, 42)}
    inputs = {name: (states(t).withColumn("part", F.slice("x", *at)), at[1]) for name, at in crops.items()}
    inputs["histogram"] = (states(t).withColumn("part", v.histogram("x", -0.5, 0.5, 32)), 32)
    out = None
    for name, (w, size) in inputs.items():
        scored = m.pca_reconstruction(w, "part", size, _ref()).withColumnRenamed("score", "pca")
        scored = m.isolation_forest(scored, "vec_id", "part", _ref()).withColumnRenamed("score", "isolation")
        vec = w.select(F.col("vec_id").alias("id"), "state", F.col("part").alias("x"))
        knn = v.knn_mean_distance(vec.select("id", "x"), vec.where(_ref()).select("id", "x")).select(F.col("id").alias("vec_id"), F.col("score").alias("knn"))
        part = ev.compare(scored.join(knn, "vec_id"), "state", "y", ["pca", "isolation", "knn"], "new", "wear").withColumn("crop", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return outputs(out)


@query("ml_auto_classify")
def _(t):
    return outputs(m.auto_evaluate(t.customer.drop("c_name"), "c_mktsegment", "c_custkey", regression=False))


@query("ml_auto_regress")
def _(t):
    return outputs(m.auto_evaluate(t.lineitem.drop("l_shipdate"), "l_extendedprice", "l_orderkey", regression=True))
