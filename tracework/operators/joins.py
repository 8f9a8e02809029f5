"""Joins: nearest-in-time, aligned, overlap and scalar application."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.operators.ordered import ordered_columns, range_count


def _stack(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, left_id: str,
           right_id: str, right_first: bool) -> DataFrame:
    """Both sides in one narrow frame: the payload rides along in structs."""
    l_rank, r_rank = (1, 0) if right_first else (0, 1)
    lpay = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    rpay = F.struct(*[F.col(c) for c in right.columns if c not in keys])
    lt = left.select(*keys, F.col(on).alias("_t"), F.lit(l_rank).alias("_side"),
                     F.col(left_id).alias("_id"), lpay.alias("_l"))
    rt = right.select(*keys, F.col(on).alias("_t"), F.lit(r_rank).alias("_side"),
                      F.col(right_id).alias("_id"), rpay.alias("_r"))
    return lt.unionByName(rt, allowMissingColumns=True)


def _emit(df: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], chosen: Column,
          suffix: str) -> DataFrame:
    rest = [c for c in left.columns if c not in keys]
    right_cols = [c for c in right.columns if c not in keys]
    return df.where(F.col("_l").isNotNull()).withColumn("_pick", chosen).select(
        *keys,
        *[F.col(f"_l.{c}").alias(c) for c in rest],
        *[F.col(f"_pick.{c}").alias(f"{c}{suffix}" if c in rest else c) for c in right_cols],
    )


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (),
              direction: str = "nearest", left_id: str = "id", right_id: str = "id",
              suffix: str = "_right") -> DataFrame:
    """Match every left row with the right row closest in ``on``.

    backward: last right row at or before; forward: first at or after; nearest: the
    closer of both, earlier one on ties; both: backward and forward side by side, the latter's columns
    with ``_ahead`` after ``suffix``.  Works without keys too: the time axis is
    cut into ranges, so neither a hot key nor an unkeyed data set lands in one task.
    Plan: one shuffle of the stacked rows plus a small border table.
    """
    by = list(by)
    stacked = _stack(left, right, by, on, left_id, right_id, right_first=direction != "forward")
    ranges = range_count(stacked)
    order = ["_t", "_side", "_id"]
    if direction == "backward":
        got = ordered_columns(stacked, by, order, ranges=ranges, last={"_p": "_r"})
        return _emit(got, left, right, by, F.col("_p"), suffix)
    if direction == "forward":
        got = ordered_columns(stacked, by, order, ranges=ranges, next={"_n": "_r"})
        return _emit(got, left, right, by, F.col("_n"), suffix)
    if direction == "both":  # among equal clock values the right rows stand on either side of the left ones, by a rank of their own
        ahead = stacked.withColumn("_side", F.when(F.col("_l").isNotNull(), 1).otherwise(F.col("_side")))
        twice = ahead.union(stacked.where("_r IS NOT NULL").withColumn("_side", F.lit(2)))
        twice = twice.withColumn("_r0", F.when(F.col("_side") == 0, F.col("_r"))).withColumn("_r2", F.when(F.col("_side") == 2, F.col("_r")))
        got = ordered_columns(twice, by, order, ranges=ranges, last={"_p": "_r0"}, next={"_n": "_r2"}).where("_l IS NOT NULL")
        rest, right_cols = ([c for c in d.columns if c not in by] for d in (left, right))
        name = lambda c, more: f"{c}{suffix if c in rest else ''}{more}"
        return got.select(*by, *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.col(f"_p.{c}").alias(name(c, "")) for c in right_cols],
                          *[F.col(f"_n.{c}").alias(name(c, "_ahead")) for c in right_cols])
    got = ordered_columns(stacked, by, order, ranges=ranges, last={"_p": "_r"}, next={"_n": "_r"})
    back, ahead = F.col("_t") - F.col(f"_p.{on}"), F.col(f"_n.{on}") - F.col("_t")
    nearer = (
        F.when(F.col("_n").isNull(), F.col("_p"))
        .when(F.col("_p").isNull(), F.col("_n"))
        .when(back <= ahead, F.col("_p"))
        .otherwise(F.col("_n"))
    )
    return _emit(got, left, right, by, nearer, suffix)


def index_aligned(tables: Mapping[str, DataFrame], state: str, id_col: str,
                  value: str) -> DataFrame:
    """Pair the i-th rows of several tables inside each state; the shortest one decides."""
    out = None
    for name, df in tables.items():
        t = ordered_columns(df, [state], [id_col], index="pair").select(
            state, "pair", F.col(value).alias(name)
        )
        out = t if out is None else out.join(t, [state, "pair"])
    return out


def row_hash(cols: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                          for c in cols]), 256)


def row_overlap(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``train`` whose row hash also occurs in ``test`` (leakage check)."""
    seen = test.select(row_hash(cols).alias("row_hash")).distinct()
    return train.withColumn("row_hash", row_hash(cols)).join(seen, "row_hash", "left_semi")


def related_items(items: DataFrame, matched: DataFrame, on: Sequence[str]) -> DataFrame:
    """All items that share the matched row's key."""
    return items.join(matched.select(*on).distinct(), list(on), "left_semi")


def apply_reference_scale(df: DataFrame, ref: DataFrame, cols: Sequence[str],
                          floor: float = 1e-12, suffix: str = "_z") -> DataFrame:
    """z-scores with mean and population std of ``ref`` (one scalar row, no join)."""
    stats = ref.agg(
        F.struct(*[s for c in cols for s in (F.avg(c).alias(f"m_{c}"),
                                             F.stddev_pop(c).alias(f"s_{c}"))])
    ).scalar()
    df = df.withColumn("_s", stats)
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.col(f"_s.m_{c}")) / F.greatest(F.col(f"_s.s_{c}"), F.lit(floor))
        for c in cols
    }).drop("_s")


def pivot_features(df: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str],
                   aggs: Mapping[str, Column], fill: float | None = None) -> DataFrame:
    """Feature frames side by side: one grouped pivot instead of repeated outer joins."""
    exprs = [c.alias(n) for n, c in aggs.items()]
    wide = df.groupBy(*keys).pivot(axis, list(values)).agg(*exprs)
    if len(aggs) == 1:
        only = next(iter(aggs))
        wide = wide.select(*keys, *[F.col(v).alias(f"{v}_{only}") for v in values])
    return wide.na.fill(fill) if fill is not None else wide
