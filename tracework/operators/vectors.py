"""Exact vector search: a small item side is shipped to the queries, a large one is cut into pivot cells that bounds rule out.

Items belong to the cell of their nearest pivot, a sample of them.  A query first visits the cells nearest to it until they hold k items;
the k-th distance found there bounds its answer.  By the triangle inequality a cell whose ball lies farther away than that bound, or behind
the plane halfway to its pivot, cannot hold a better item, so the second visit goes to the remaining cells only.  Every (cell block,
query block) is one task of bounded size; pairs never leave a task.  Cosine search runs on unit vectors, where both orders agree.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from tracework.operators.windows import top_k
from tracework.session import materialise

#: Rows of a cell block, of a query block, and average rows of a cell.
BLOCK_ROWS, CELL_ROWS = 20_000, 2_000
#: Pivots at most: every query is compared with all of them.
MOST_PIVOTS = 4096
#: Items of at most so many numbers are shipped whole.
SHIPPED = 4_000_000
#: Numbers of a table of distances that a task holds at a time, and rows that a task hands on at a time.
TABLE, HANDED = 2_000_000, 4096
COSINE_MATCH = 0.8
MEMORY_PATCHES = 20_000
#: Slack of the bounds against rounding.
SLACK = 1e-7


def _matrix(column: pd.Series, cosine: bool, item: bool) -> np.ndarray:
    """Rows as numbers; for cosine as unit vectors, with two more coordinates in which null vectors of the two sides stand apart,
    so that their product with everything is 0."""
    x = np.stack(column.to_numpy()).astype(float)
    if not cosine:
        return x
    norm = np.linalg.norm(x, axis=1)
    out = np.zeros((len(x), x.shape[1] + 2))
    out[:, :-2] = x / np.where(norm > 0, norm, 1)[:, None]
    out[norm == 0, -1 if item else -2] = 1
    return out


def _chunks(n: int, width: int) -> list[slice]:
    """``n`` rows cut so that a table with ``width`` numbers per row stays within ``TABLE``, however many rows or columns there are."""
    step = max(1, min(HANDED, TABLE // max(width, 1)))
    return [slice(at, at + step) for at in range(0, n, step)]


def _best(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, cosine: bool):
    """For each row of ``x``: its k best rows of ``y`` (sorted by id), exact values, ties to the smaller id."""
    kk = min(k, len(ids))
    take = min(len(ids), kk + 8)
    square = None if cosine else (y * y).sum(1)[None, :]
    for rows in _chunks(len(x), len(y)):
        part = x[rows]
        cost = -np.round(part @ y.T, 12) if cosine else np.maximum((part * part).sum(1)[:, None] + square - 2 * part @ y.T, 0)
        # wider preselection, then exact values
        idx = np.argpartition(cost, take - 1, axis=1)[:, :take]
        edge = np.take_along_axis(cost, idx, 1).max(axis=1)
        for r in range(len(part)):
            cand = np.flatnonzero(cost[r] <= edge[r] + 1e-9) if take < len(ids) else idx[r]
            exact = cost[r, cand] if cosine else np.round(np.sqrt(((part[r] - y[cand]) ** 2).sum(1)), 12)
            order = np.lexsort((ids[cand], exact))[:kk]
            yield rows.start + r, ids[cand][order], exact[order]


def _frame(query_ids: np.ndarray, found) -> pd.DataFrame:
    rows = [(np.full(len(i), query_ids[r]), i, v) for r, i, v in found]
    cells = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "item_id", "value"), cells, strict=True)))


FOUND = "query_id bigint, item_id bigint, value double"


def _shipped(queries: DataFrame, items: DataFrame, k: int, cosine: bool) -> DataFrame:
    """All items, whose size has been checked, go to the tasks that read the queries: nothing is shuffled."""
    pdf = items.select("id", "x").toPandas().sort_values("id")
    spark = queries.sparkSession
    if pdf.empty:
        return spark.createDataFrame([], FOUND)
    known = spark.sparkContext.broadcast((_matrix(pdf["x"], cosine, True), pdf["id"].to_numpy()))

    def run(frames):
        y, ids = known.value
        for q in frames:
            if len(q):
                yield _frame(q["id"].to_numpy(), _best(_matrix(q["x"], cosine, False), y, ids, k, cosine))

    return queries.select("id", "x").mapInPandas(run, FOUND)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


class Cells:
    """Pivots of the items and what is known of their cells: radius and number of items."""

    def __init__(self, items: DataFrame, n: int, cosine: bool):
        self.cosine = cosine
        want = max(1, min(MOST_PIVOTS, -(-n // CELL_ROWS)))
        drawn = items.select("id", "x").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(want).toPandas()
        self.pivots = _matrix(drawn["x"], cosine, True)
        self.between = _distances(self.pivots, self.pivots)
        pivots = items.sparkSession.sparkContext.broadcast(self.pivots)

        def place(frames):
            for pdf in frames:
                for rows in _chunks(len(pdf), len(pivots.value)):
                    part = pdf.iloc[rows]
                    d = _distances(_matrix(part["x"], cosine, True), pivots.value)
                    cell = d.argmin(1)
                    yield part.assign(cell=cell.astype(np.int32), away=d[np.arange(len(d)), cell])

        self.items = materialise(items.select("id", "x").mapInPandas(place, "id bigint, x array<double>, cell int, away double"), "cells")
        # one row per pivot
        known = {r["cell"]: r for r in self.items.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
        self.radius = np.array([known[c]["radius"] if c in known else -np.inf for c in range(want)])
        self.count = np.array([known[c]["n"] if c in known else 0 for c in range(want)])

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells of each query, as many as it takes to hold k items."""
        order = np.argsort(np.where(self.count > 0, d, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        chosen = np.zeros(d.shape, bool)
        np.put_along_axis(chosen, order, (held - self.count[order] < k) & (self.count[order] > 0), axis=1)
        return chosen

    def reached(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Cells that may hold an item within ``bound`` of the query: by their ball, and by the planes halfway to their pivots."""
        ball = d - self.radius[None, :] <= bound[:, None] + SLACK
        own = d.argmin(1)
        gap = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap)
        return ball & ~(plane > bound[:, None] + SLACK) & (self.count > 0)


def visits(queries: DataFrame, cells: Cells, k: int, bounds: DataFrame | None = None) -> DataFrame:
    """``id``, ``x`` and ``cell`` for every cell a query has to look at: at first, or, given its ``bound``, in addition."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.radius, cells.count, cells.between))
    cosine, again = cells.cosine, bounds is not None

    def run(frames):
        c = Cells.__new__(Cells)
        c.pivots, c.radius, c.count, c.between = shared.value
        for pdf in frames:
            for rows in _chunks(len(pdf), len(c.pivots)):
                part = pdf.iloc[rows]
                d = _distances(_matrix(part["x"], cosine, False), c.pivots)
                chosen = c.first(d, k)
                if again:
                    chosen = c.reached(d, part["bound"].to_numpy()) & ~chosen
                row, cell = np.nonzero(chosen)
                ids, x = part["id"].to_numpy(), part["x"].to_numpy()
                for at in range(0, len(row), HANDED):
                    few = row[at:at + HANDED]
                    yield pd.DataFrame({"id": ids[few], "x": x[few], "cell": cell[at:at + HANDED].astype(np.int32)})

    rows = queries.select("id", "x")
    if again:
        rows = rows.join(bounds, "id")
    return rows.mapInPandas(run, "id bigint, x array<double>, cell int")


def _search(visited: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The k best items of each (query, cell); crowded cells and their queries are dealt out in blocks."""
    visited = materialise(visited, "visits")
    asked = visited.groupBy("cell").agg(F.count(F.lit(1)).alias("_q"))
    held = cells.items.groupBy("cell").agg(F.count(F.lit(1)).alias("_i"))
    parts = asked.join(held, "cell").select("cell", F.ceil(F.col("_q") / BLOCK_ROWS).cast("int").alias("_nq"), F.ceil(F.col("_i") / BLOCK_ROWS).cast("int").alias("_ni"))
    deal = lambda d, own, other, mine, n_mine, n_other: d.join(parts, "cell").select(
        "cell", "id", "x", F.pmod(F.xxhash64("id"), F.col(n_mine)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other))
    q, it = deal(visited, "qb", "ib", "q", "_nq", "_ni"), deal(cells.items, "ib", "qb", "i", "_ni", "_nq")
    cosine = cells.cosine

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _frame(np.zeros(0, np.int64), [])
        b = b.sort_values("id")
        return _frame(a["id"].to_numpy(), _best(_matrix(a["x"], cosine, False), _matrix(b["x"], cosine, True), b["id"].to_numpy(), k, cosine))

    keys = ["cell", "qb", "ib"]
    return q.groupBy(*keys).cogroup(it.groupBy(*keys)).applyInPandas(best, FOUND)


def nearest(queries: DataFrame, items: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """k best items per query: query_id, item_id, value (distance or cosine), rank.

    Inputs have columns id (bigint) and x (array); null vectors are left out.
    """
    cosine = metric == "cosine"
    queries, items = (d.where("x IS NOT NULL").select("id", F.col("x").cast("array<double>").alias("x")) for d in (queries, items))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("numbers")).first()
    if size["numbers"] <= SHIPPED:
        found = _shipped(queries, items, k, cosine)
    else:
        cells = Cells(items, size["n"], cosine)
        near = materialise(_search(visits(queries, cells, k), cells, k), "near")
        # the k-th best so far, as a distance; visited cells hold k items unless there are fewer at all
        kth = top_k(near.withColumn("_s", -F.col("value")), "_s", k, "item_id", ["query_id"]).groupBy(F.col("query_id").alias("id")).agg(F.max("value").alias("worst"))
        bound = F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.col("worst"))) if cosine else F.col("worst")
        found = near.union(_search(visits(queries, cells, k, kth.select("id", bound.alias("bound"))), cells, k))
    ranked = top_k(found.withColumn("_s", -F.col("value")), "_s", k, "item_id", ["query_id"]).drop("_s")
    return ranked.withColumn("value", -F.col("value")) if cosine else ranked


def cosine_top1(queries: DataFrame, items: DataFrame, match: float = COSINE_MATCH) -> DataFrame:
    """Most similar item per query and whether it counts as a match."""
    return nearest(queries, items, 1, "cosine").select(
        "query_id", "item_id", F.col("value").alias("similarity"), (F.col("value") >= match).alias("matched"))


def knn_mean_distance(rows: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """Mean distance to the k nearest training rows (training rows find themselves at 0)."""
    return nearest(rows, train, k).groupBy(F.col("query_id").alias("id")).agg(F.avg("value").alias("score"))


def memory_bank(patches: DataFrame, id_col: str, n: int = MEMORY_PATCHES, seed: int = 42) -> DataFrame:
    """At most n training patches without replacement, in hash order (a sampling operator)."""
    from tracework.operators.quality import sample_rows

    return sample_rows(patches, id_col, n, seed)


def patch_scores(patches: DataFrame, bank: DataFrame, image: str) -> DataFrame:
    """Distance of every patch to its nearest bank patch; patches: id, x and the image column."""
    d = nearest(patches, bank, 1).select(F.col("query_id").alias("id"), F.col("value").alias("patch_score"))
    return patches.drop("x").join(d, "id")


def image_scores(scored: DataFrame, image: str) -> DataFrame:
    return scored.groupBy(image).agg(F.max("patch_score").alias("score"))


def heatmap(scored: DataFrame, image: str) -> DataFrame:
    """Patch scores of each image shifted to 0 and scaled to 1 unless flat."""
    from tracework.operators.quality import with_group_stats

    d = with_group_stats(scored, [image], F.min("patch_score").alias("_lo"), F.max("patch_score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    shifted = F.col("patch_score") - F.col("_lo")
    return d.withColumn("heat", F.when(span > 1e-12, shifted / F.when(span > 0, span)).otherwise(shifted)).drop("_lo", "_hi")


def histogram(x: str, low: float, high: float, bins: int):
    """Share of the array's values in each of ``bins`` equal parts of [low, high]; values outside count in the end parts."""
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins).cast("int")))
    slots = F.transform(x, place)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(slots, lambda s: s == b)) / F.size(x))


def embed(df: DataFrame, content: str, dims: int, model) -> DataFrame:
    """Apply a pluggable ``model(list of inputs) -> array (n, dims)`` in Arrow batches."""
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(frames):
        for pdf in frames:
            out = np.asarray(model(pdf[content].tolist()), dtype=np.float32).reshape(len(pdf), dims)
            yield pdf.assign(embedding=list(out))

    return df.mapInPandas(run, schema)
