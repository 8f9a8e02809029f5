"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine ``c`` lie within squared distance ``2 - 2c``. After a fixed random rotation the coordinates are split into
``BLOCKS`` blocks; if two vectors are that close, the squared distance in some block is at most its proportional share of the budget.
So each block is range-joined by itself: the leading coordinates of a block are cut into cells of twice the block's radius, a vector
lives in one cell and visits those later cells its radius reaches, and only vectors that meet in a cell are compared. A pair is
counted in the first block whose share it keeps and is verified there by its cosine in double precision, so the union over
blocks has no doubles and no pair is ever written out: a task returns links per vector and the groups it has seen.

Equal vectors are joined into one row first. A crowded cell is dealt out as pairs of chunks of at most about ``CHUNK`` rows, all of
them, so no task grows with the crowd and nothing is left out.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with
nothing and are their own component; only vectors of equal label and length are compared; rows that repeat an id are
vectors of their own; extra columns are ignored.
"""
from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tracework.llm.graph import components
from tracework.llm.repeats import stored

COSINE = 0.98
BLOCKS = 4
CHUNK = 4096
TILE = 1 << 15
SLACK = 1e-9
CELL = ["label", "width", "block", "cx", "cy"]


@lru_cache(maxsize=64)
def rotation(width: int) -> np.ndarray:
    """The same orthonormal matrix on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return np.round(q * np.sign(np.diag(r)), 12)


def bounds(width: int) -> list[tuple[int, int]]:
    blocks = max(1, min(BLOCKS, width // 2))
    cuts = [width * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates. Columns are added one by one, so a row's result never depends on its neighbours."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    turn, out = rotation(x.shape[1]), np.zeros_like(x)
    for j in range(x.shape[1]):
        out += unit[:, j : j + 1] * turn[j]
    return out


def _named(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows with a digest ``k`` of label and components (null if unusable) and the components as bytes, single floats as such."""
    single = isinstance(df.schema[vector_col].dataType.elementType, FloatType)
    number = np.float32 if single else np.float64
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).cast("string").alias("label"))

    def run(batches):
        for batch in batches:
            vectors = batch.column("v")
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(number, copy=False)  # null components become NaN
            width = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            end = np.cumsum(width)
            names: list[bytes | None] = []
            data: list[bytes | None] = []
            for a, b, label in zip((end - width).tolist(), end.tolist(), batch.column("label").to_pylist(), strict=True):
                wide = values[a:b].astype(np.float64)
                square = float((wide * wide).sum())
                usable = label is not None and 0 < square < np.inf
                data.append(values[a:b].tobytes() if usable else None)
                names.append(blake2b(data[-1], digest_size=16, key=blake2b(label.encode(), digest_size=16).digest()).digest() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(width, pa.int32()), pa.array(names, pa.binary()), pa.array(data, pa.binary())],
                                             names=["id", "label", "width", "k", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label string, width int, k binary, x binary")


def _numbers(x: pd.Series, width: int) -> np.ndarray:
    """Vectors of one width as a matrix of double precision."""
    data = b"".join(x)
    return np.frombuffer(data, np.float32 if len(data) == 4 * width * len(x) else np.float64).reshape(len(x), width).astype(np.float64)


def _cells(vectors: DataFrame, budget: float) -> DataFrame:
    """Home cell and visited cells of each vector in each block."""
    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for width, part in frame.groupby("width"):
                y = rotated(_numbers(part["x"], int(width)))
                blocks = bounds(int(width))
                radius = np.sqrt(budget / len(blocks)) * (1 + 1e-6)
                side = 2 * radius
                for b, (lo, hi) in enumerate(blocks):
                    axes = [y[:, lo], y[:, lo + 1] if hi - lo > 1 else np.zeros(len(y))]
                    home = [np.floor(a / side).astype(np.int32) for a in axes]
                    first = [np.floor((a - radius) / side).astype(np.int32) for a in axes]
                    last = [np.floor((a + radius) / side).astype(np.int32) for a in axes]
                    for dx in (-1, 0, 1):
                        for dy in (-1, 0, 1):
                            if (dx, dy) < (0, 0):
                                continue  # visits go to later cells only: one meeting per pair
                            cx, cy = home[0] + dx, home[1] + dy
                            go = np.flatnonzero((first[0] <= cx) & (cx <= last[0]) & (first[1] <= cy) & (cy <= last[1]))
                            if len(go):
                                sub = part.iloc[go]
                                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                                    "label": sub["label"].to_numpy(), "width": np.int32(width), "block": np.int32(b), "cx": cx[go], "cy": cy[go],
                                    "visits": (dx, dy) != (0, 0), "k": sub["k"].to_numpy(), "copies": sub["copies"].to_numpy(), "x": sub["x"].to_numpy()}), preserve_index=False)

    return vectors.mapInArrow(run, "label string, width int, block int, cx int, cy int, visits boolean, k binary, copies long, x binary")


def _dealt(cells: DataFrame) -> DataFrame:
    """Chunk pairs of crowded cells: every row meets every chunk of its cell."""
    parts = cells.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum((~F.col("visits")).cast("long")).alias("homes")).where("n > 1 and homes > 0")
    # written first: a join whose two sides are plain shuffles lets adaptive execution split a crowded cell
    parts = stored(parts.select(*CELL, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "cells")
    rows = cells.join(parts, CELL).withColumn("chunk", F.pmod(F.xxhash64("k", "visits"), F.col("chunks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other"))


def _grouped(ends: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' groups, by passing minima along the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
        new = root.copy()
        np.minimum.at(new, ends[:, 0], low)
        np.minimum.at(new, ends[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(key: tuple, frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links inside one cell (or one pair of its chunks): per vector its links, and one edge to its group's first vector."""
    width, block, one, two = int(key[1]), int(key[2]), int(key[5]), int(key[6])
    frame = frame.sort_values(["chunk", "visits", "k"], ignore_index=True)
    blocks = bounds(width)
    share = (2 - 2 * cosine) / len(blocks) + SLACK
    lo, hi = blocks[block]
    x = _numbers(frame["x"], width)
    y = rotated(x)
    line = np.argsort(y[:, hi - 1], kind="stable")  # rows along the block's last coordinate: only neighbours on it can be close
    frame, x, y = frame.iloc[line], x[line], y[line]
    place, norm, reach = y[:, hi - 1], np.sqrt((x * x).sum(1)), np.sqrt(share) * (1 + 1e-6)
    visits, chunk, copies = (frame[c].to_numpy() for c in ("visits", "chunk", "copies"))
    part = y[:, lo:hi]
    square = (part * part).sum(1)
    links, ends = np.zeros(len(x), np.int64), []
    step = 256
    for at in range(0, len(x), step):
        to = min(at + step, len(x))
        end = int(np.searchsorted(place, place[to - 1] + reach, "right"))
        near = square[at:to, None] + square[None, at:end] - 2 * part[at:to] @ part[at:end].T <= share + 1e-9
        a, b = np.nonzero(near)
        a, b = a + at, b + at
        good = (a < b) & ~(visits[a] & visits[b])
        if one != two:
            good &= chunk[a] != chunk[b]
        a, b = a[good], b[good]
        for s in range(0, len(a), TILE):
            p, q = a[s : s + TILE], b[s : s + TILE]
            gap = (y[p] - y[q]) ** 2
            first = np.ones(len(p), bool)
            for i, (u, v) in enumerate(blocks[: block + 1]):
                within = gap[:, u:v].sum(1) <= share
                first &= within if i == block else ~within
            p, q = p[first], q[first]
            linked = (x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= cosine
            p, q = p[linked], q[linked]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            if len(p):
                ends.append(np.column_stack([p, q]))
    if not ends:
        return pd.DataFrame({"k": [], "links": [], "root": []})
    root = _grouped(np.concatenate(ends), len(x))
    used = np.flatnonzero(links)
    node = frame["k"].to_numpy()
    return pd.DataFrame({"k": node[used], "links": links[used], "root": node[root[used]]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``id``, ``n_links`` (other vectors linked directly) and ``component_id`` (smallest id reachable) of each vector."""
    rows = stored(_named(df, id_col, vector_col, label_col), "vectors")
    groups = stored(rows.where("k is not null").groupBy("k").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("width").alias("width"), F.first("x").alias("x")), "distinct")
    dealt = _dealt(_cells(groups, 2 - 2 * cosine))
    found = stored(dealt.groupBy(*CELL, "one", "two").applyInPandas(lambda key, frame: _compare(key, frame, cosine), "k binary, links long, root binary"), "links")
    # nodes begin with their smallest id, so the smallest node of a component names it and nothing is joined by component
    node = F.struct(F.col("least").isNull().alias("none"), "least", "k").alias("node")
    nodes = stored(groups.select("k", node), "nodes")
    edges = found.where("k <> root").select("k", "root").distinct()
    edges = edges.join(nodes.toDF("k", "a"), "k").join(nodes.toDF("root", "b"), "root").select("a", "b")
    roots = components(edges).select(F.col("node.k").alias("k"), F.col("root.least").alias("component"))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    known = groups.select("k", "copies", "least").join(links, "k", "left").join(roots, "k", "left")
    known = known.select("k", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component"))
    used = rows.where("k is not null").select("id", "k").join(stored(known, "known"), "k").select("id", "n", "component")
    alone = rows.where("k is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return used.union(alone).select("id", F.col("n").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def digest(df: DataFrame) -> DataFrame:
    out = near_vectors(df)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND CASE WHEN len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_dot_product(e, e) > 0 ELSE false END),
links AS (SELECT a.r AS ra, b.r AS rb, a.vec_id AS va, b.vec_id AS vb FROM ok a JOIN ok b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT va AS v, vb AS w FROM links UNION SELECT reach.v, links.vb FROM reach JOIN links ON reach.w = links.va),
low AS (SELECT v, min(w) AS w FROM reach GROUP BY v), deg AS (SELECT ra, count(*) AS n FROM links GROUP BY ra)
SELECT v.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.w, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(low.w, v.vec_id)) AS kept
FROM v LEFT JOIN deg ON deg.ra = v.r LEFT JOIN low ON low.v = v.vec_id
"""
