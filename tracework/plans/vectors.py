"""Image-vector operators on the embedding table."""
from pyspark.sql import functions as F

from tracework.operators import vectors as v
from tracework.plans.registry import outputs, query

E_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def ids(t, cond=None):
    d = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"), "label")
    return d.where(cond) if cond is not None else d


@query("vec_cosine_top1", f"""WITH {E_SQL}, s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.x, i.x), 12) AS c
 FROM e q JOIN e i ON q.label <> 0 AND i.label = 0)
SELECT query_id, item_id, round(c, 6) AS similarity, c >= 0.8 AS matched FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) = 1""")
def _(t):
    return outputs(v.cosine_top1(ids(t, F.col("label") != 0), ids(t, F.col("label") == 0)))


@query("vec_knn_mean_dist", f"""WITH {E_SQL}, s AS (SELECT q.vec_id AS id, list_distance(q.x, i.x) AS d FROM e q JOIN e i ON i.label = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) <= 5) SELECT id, round(avg(d), 6) AS score FROM k GROUP BY 1""")
def _(t):
    return outputs(v.knn_mean_distance(ids(t), ids(t, F.col("label") == 0)))


# eight patches of eight values per image
P_SQL = """p AS (SELECT vec_id AS image, label, vec_id * 8 + b AS id, embedding[b * 8 + 1 : b * 8 + 8]::DOUBLE[] AS x FROM embeddings, unnest(range(8)) u(b))"""


def patches(t):
    b = F.explode(F.sequence(F.lit(0), F.lit(7)))
    d = t.embeddings.select(F.col("vec_id").alias("image"), "label", F.transform("embedding", lambda c: c.cast("double")).alias("e"), b.alias("b"))
    return d.select("image", "label", (F.col("image") * 8 + F.col("b")).alias("id"), F.slice("e", F.col("b") * 8 + 1, 8).alias("x"))


def bank(t):
    return v.memory_bank(patches(t).where("label = 0").select("id", "x"), "id")


BANK_SQL = P_SQL + ", k AS (SELECT id, x FROM p WHERE label = 0 ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 20000)"
SCORE_SQL = BANK_SQL + ", s AS (SELECT p.image, p.id, min(list_distance(p.x, k.x)) AS patch_score FROM p, k GROUP BY 1, 2)"


@query("vec_memory_bank", f"WITH {BANK_SQL} SELECT id FROM k")
def _(t):
    return bank(t).select("id")


@query("vec_patch_score", f"WITH {SCORE_SQL} SELECT image, round(max(patch_score), 6) AS score FROM s GROUP BY 1")
def _(t):
    return outputs(v.image_scores(v.patch_scores(patches(t), bank(t), "image"), "image"))


@query("vec_heatmap", f"""WITH {SCORE_SQL}, m AS (SELECT *, min(patch_score) OVER (PARTITION BY image) AS lo, max(patch_score) OVER (PARTITION BY image) AS hi FROM s)
SELECT image, id, round(CASE WHEN hi - lo > 1e-12 THEN (patch_score - lo) / (hi - lo) ELSE patch_score - lo END, 6) + 0.0 AS heat FROM m""")
def _(t):
    return outputs(v.heatmap(v.patch_scores(patches(t), bank(t), "image"), "image").select("image", "id", "heat"))


@query("vec_embed")
def _(t):
    """Embedding contract: any batch function; here a hashed letter profile of each text."""
    import numpy as np

    def model(texts):
        out = np.zeros((len(texts), 16))
        for i, s in enumerate(texts):
            codes = np.frombuffer(s.encode("utf-8"), dtype=np.uint8)
            out[i] = np.bincount(codes % 16, minlength=16) / max(len(codes), 1)
        return out

    d = v.embed(t.documents.select("doc_id", "text"), "text", 16, model)
    return d.select("doc_id", F.posexplode("embedding").alias("k", "x")).select("doc_id", "k", F.round(F.col("x").cast("double"), 6).alias("x"))


_PIX = "p AS (SELECT vec_id, least(greatest(unnest(embedding)::DOUBLE * 0.5 + 0.5, 0.0), 1.0) AS g FROM embeddings)"


def pixels(t):
    g = F.least(F.greatest(F.col("x") * 0.5 + 0.5, F.lit(0.0)), F.lit(1.0))
    return t.points.select("vec_id", g.alias("g"))


@query("img_pixel_moments", f"""WITH {_PIX}, m AS (SELECT vec_id, avg(g) AS m FROM p GROUP BY 1)
SELECT vec_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, round(avg(power(g-m,3))/power(avg(power(g-m,2)),1.5), 5) + 0.0 AS skew,
 round(avg(power(g-m,4))/power(avg(power(g-m,2)),2) - 3, 5) + 0.0 AS kurtosis FROM p JOIN m USING (vec_id) GROUP BY 1""")
def _(t):
    d = pixels(t).groupBy("vec_id").agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.skewness("g").alias("skew"), F.kurtosis("g").alias("kurtosis"))
    return outputs(d, 6, skew=5, kurtosis=5)


@query("img_gray_histogram", f"""WITH {_PIX} SELECT vec_id, least(floor((g - 0.0) / 1.0 * 64), 63)::INTEGER AS bin, count(*) AS n,
 round(count(*) / (64 * (1 / 64.0::DOUBLE)), 6) AS density FROM p GROUP BY 1, 2""")
def _(t):
    from tracework.operators.aggregates import histogram

    return outputs(histogram(pixels(t), ["vec_id"], "g", 0.0, 1.0, 64))
