"""Evaluation and score fusion on the given tables."""
from pyspark.sql import functions as F

from tracework.operators import evaluate as ev
from tracework.operators import joins as j
from tracework.operators import models as m
from tracework.plans.joins import _ALIGN_SQL, aligned_scores
from tracework.plans.registry import outputs, query

SCORES = ("s1", "s2", "s3", "s4")
# two decimals on purpose: many ties
SC = """x AS (SELECT vec_id, (label <> 0)::INTEGER AS y, CASE WHEN label = 0 THEN 'new' ELSE 'wear' END AS state,
 round(embedding[1]::DOUBLE, 2) + 0.0 AS s1, round(embedding[2]::DOUBLE, 2) + 0.0 AS s2, round(embedding[3]::DOUBLE, 2) + 0.0 AS s3, round(embedding[4]::DOUBLE, 2) + 0.0 AS s4 FROM embeddings),
u AS (SELECT y, state, 's1' AS method, s1 AS s FROM x UNION ALL SELECT y, state, 's2', s2 FROM x UNION ALL SELECT y, state, 's3', s3 FROM x UNION ALL SELECT y, state, 's4', s4 FROM x),
c AS (SELECT method, s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM u GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method) AS p, sum(neg) OVER (PARTITION BY method) AS n FROM c WINDOW w AS (PARTITION BY method ORDER BY s DESC))"""


def scored(t):
    from tracework.functions.numeric import rounded

    return t.embeddings.select(
        "vec_id", (F.col("label") != 0).cast("int").alias("y"), F.when(F.col("label") == 0, "new").otherwise("wear").alias("state"),
        *[rounded(F.element_at("embedding", i + 1).cast("double"), 2).alias(s) for i, s in enumerate(SCORES)])


def _long(t):
    from tracework.operators.aggregates import long_features

    return long_features(scored(t), ["y"], SCORES)


@query("ev_roc_auc", f"WITH {SC} SELECT method AS feature, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(p * n), 9) AS roc_auc FROM r GROUP BY 1")
def _(t):
    return outputs(ev.areas(_long(t), ["feature"], "y", "value").select("feature", "roc_auc"), 9)


@query("ev_average_precision", f"WITH {SC} SELECT method AS feature, round(sum(pos * tp / (tp + fp)) / max(p), 9) AS pr_auc FROM r GROUP BY 1")
def _(t):
    return outputs(ev.areas(_long(t), ["feature"], "y", "value").select("feature", "pr_auc"), 9)


@query("ev_roc_curve", f"WITH {SC} SELECT method AS feature, s AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM r")
def _(t):
    return outputs(ev.roc_curve(_long(t), ["feature"], "y", "value"), 9)


@query("ev_pr_curve", f"WITH {SC} SELECT method AS feature, s AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM r")
def _(t):
    return outputs(ev.pr_curve(_long(t), ["feature"], "y", "value"), 9)


_PRED = "SELECT quality AS y, (n_chars > 1000)::INTEGER AS pred FROM labels JOIN documents USING (doc_id)"


def _predicted(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("pred"))


@query("ev_confusion", f"SELECT y, pred, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def _(t):
    return ev.confusion(_predicted(t), "y", "pred")


@query("ev_class_report", f"""WITH x AS ({_PRED}), k AS (SELECT unnest([0, 1]) AS c),
g AS (SELECT c, count(*) FILTER (y = c AND pred = c) AS tp, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS predicted FROM x, k GROUP BY 1),
m AS (SELECT c::VARCHAR AS class, tp, support, tp / predicted AS precision, tp / support AS recall, 2.0::DOUBLE * tp / (predicted + support) AS f1 FROM g),
o AS (SELECT class, precision, recall, f1, support FROM m UNION ALL SELECT 'accuracy', sum(tp)/sum(support), sum(tp)/sum(support), sum(tp)/sum(support), sum(support)::BIGINT FROM m
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m
 UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support)::BIGINT FROM m)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM o""")
def _(t):
    return outputs(ev.class_report(_predicted(t), "y", "pred"), 9)


_CMP = """, m AS (SELECT method, avg(s) FILTER (state = 'new') AS a, avg(s) FILTER (state = 'wear') AS b FROM u GROUP BY 1)
SELECT r.method, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(p * n), 9) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 9) AS pr_auc,
 round(max(a), 7) + 0.0 AS ref_mean, round(max(b), 7) + 0.0 AS test_mean, round(max(b - a), 7) + 0.0 AS difference FROM r JOIN m ON m.method = r.method GROUP BY 1"""


@query("ev_compare_models", f"WITH {SC}{_CMP}")
def _(t):
    return outputs(ev.compare(scored(t), "state", "y", SCORES, "new", "wear"), 9, ref_mean=7, test_mean=7, difference=7)


_Z = ", ".join(f"({c} - avg({c}) FILTER (state = 'new') OVER ()) / greatest(stddev_pop({c}) FILTER (state = 'new') OVER (), 1e-12) AS {c}_z" for c in ("force", "punch", "sheet"))


@query("fus_scores", f"""WITH {_ALIGN_SQL}, z AS (SELECT state, pair, {_Z} FROM a)
SELECT state, pair, round(force_z, 6) + 0.0 AS force_only, round(punch_z, 6) + 0.0 AS punch_only, round(sheet_z, 6) + 0.0 AS sheet_only, round((force_z + sheet_z) / 2, 6) + 0.0 AS force_plus_sheet,
 round((force_z + punch_z) / 2, 6) + 0.0 AS force_plus_punch, round((punch_z + sheet_z) / 2, 6) + 0.0 AS punch_plus_sheet, round((force_z + punch_z + sheet_z) / 3, 6) + 0.0 AS force_plus_punch_plus_sheet FROM z""")
def _(t):
    a = aligned_scores(t)
    z = j.apply_reference_scale(a, a.where("state = 'new'"), ["force", "punch", "sheet"])
    return outputs(ev.fuse(z).drop("force", "punch", "sheet", "force_z", "punch_z", "sheet_z"))


@query("ml_threshold", "SELECT doc_id, (p > 0.8)::INTEGER AS strict, (p >= 0.5)::INTEGER AS plain FROM (SELECT doc_id, n_chars / 4000.0::DOUBLE AS p FROM documents)")
def _(t):
    d = t.documents.select("doc_id", (F.col("n_chars") / 4000.0).alias("p"))
    return ev.threshold(ev.threshold(d, "p", 0.8, False, "strict"), "p", 0.5, True, "plain").drop("p")


@query("ml_false_positives", "SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 0 AND n_chars > 1000")
def _(t):
    return ev.false_positives(_predicted(t), "y", "pred").select("doc_id")


@query("ml_scale_train_only", """
WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents WHERE lang = 'en')
SELECT doc_id, round((n_chars - m) / greatest(d, 1e-12), 6) + 0.0 AS n_chars_z FROM documents, s""")
def _(t):
    d = t.documents.select("doc_id", "lang", "n_chars")
    return outputs(j.apply_reference_scale(d, d.where("lang = 'en'"), ["n_chars"]).select("doc_id", "n_chars_z"))


@query("ml_impute_mean", """
WITH x AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM x)), 6) AS v FROM x""")
def _(t):
    x = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return outputs(m.impute_mean(x, ["v"]))


@query("ml_train_test_split", """
WITH h AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY substr(md5(doc_id::VARCHAR || ':42'), 1, 12), doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN (i + 0.5) / n < 0.7::DOUBLE THEN 'train' WHEN (i + 0.5) / n < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM h""")
def _(t):
    d = t.labels.select("doc_id", "quality")
    return m.split(d, "doc_id", {"train": 0.7, "validation": 0.2, "test": 0.1}, "quality")
