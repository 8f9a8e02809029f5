"""Prominent peaks of long signals, decided block by block.

Both rules are exact for signals of any length: what a block of samples cannot decide on
its own is passed on, first to a table of block extremes, then to the one block that matters.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.operators.features_freq import local_maxima
from tracework.operators.ordered import ordered_columns
from tracework.session import materialise

BLOCK = 65_536
GROUP = 1024  # blocks whose open requests are answered together
OPEN, KEPT, GONE = 0, 1, 2


def _schema(df: DataFrame, names: Sequence[str], extra: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"`{n}` {types[n]}" for n in names], extra])


def keep_distance(peaks: DataFrame, keys: Sequence[str], index: str, value: str, distance: int, block: int = BLOCK) -> DataFrame:
    """Highest peaks first, none closer than ``distance`` to a kept one (later one first on equal height).

    A peak is settled once every higher neighbour in reach is settled.  A block settles all it
    can see; chains that cross a border are finished in the next round.
    """
    keys, reach = list(keys), distance - 1
    if reach < 1:
        return peaks
    block = max(block, reach)
    schema = _schema(peaks, [*keys, index, value], "status int")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index).reset_index(drop=True)
        at, height = pdf[index].to_numpy(), pdf[value].to_numpy()
        status, own = pdf["status"].to_numpy().copy(), pdf["_own"].to_numpy()
        lo, hi = np.searchsorted(at, at - reach, "left"), np.searchsorted(at, at + reach, "right")
        higher = np.lexsort((at, height))[::-1]
        rank = np.empty(len(at), dtype=int)
        rank[higher] = np.arange(len(at))
        for p in higher:
            if status[p] != OPEN:
                continue
            near = slice(lo[p], hi[p])
            above = status[near][rank[near] < rank[p]]
            if (above == KEPT).any():
                status[p] = GONE
            elif own[p] and not (above == OPEN).any():
                status[p] = KEPT
        pdf["status"] = status
        return pdf.loc[own & (status != GONE), [*keys, index, value, "status"]]

    state = materialise(peaks.select(*keys, index, value, F.lit(OPEN).alias("status")), "peaks")
    while True:
        home = F.floor(F.col(index) / block)
        seen = F.array_distinct(F.array(F.floor((F.col(index) - reach) / block), home, F.floor((F.col(index) + reach) / block)))
        d = state.withColumn("_blk", F.explode(seen)).withColumn("_own", F.col("_blk") == home)
        state = materialise(d.groupBy(*keys, "_blk").applyInPandas(settle, schema), "peaks")
        if state.where(F.col("status") == OPEN).isEmpty():
            return state.drop("status")


def _first(x: np.ndarray, high: float, low: float):
    """Walking along x: 1 if a value <= low comes before one > high, 0 if after, None if neither appears."""
    up, down = np.flatnonzero(x > high), np.flatnonzero(x <= low)
    if len(down) and (not len(up) or down[0] < up[0]):
        return 1
    return 0 if len(up) else None


def prominent(peaks: DataFrame, signal: DataFrame, keys: Sequence[str], index: str, value: str, drop: str, block: int = BLOCK) -> DataFrame:
    """Peaks from which the signal falls by ``drop`` on both sides before it rises above the peak.

    ``peaks`` has keys, index, value and drop; ``signal`` has keys, index and value.
    """
    keys = list(keys)
    blk = lambda c: F.floor(F.col(c) / block).cast("long")
    samples = signal.select(*keys, blk(index).alias("_blk"), F.col(index).alias("_i"), F.col(value).alias("_v"))
    asks = peaks.select(*keys, blk(index).alias("_blk"), index, value, drop)
    cols = [*keys, index, value, drop]
    schema = _schema(asks, cols, "side int, _home bigint, ok int")
    names = [*cols, "side", "_home", "ok"]

    def inside(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, rows = a.sort_values("_i"), []
        at, v = a["_i"].to_numpy(), a["_v"].to_numpy()
        for r in b.to_dict("records"):
            pos = np.searchsorted(at, r[index])
            for side, x in ((-1, v[:pos][::-1]), (1, v[pos + 1:])):
                rows.append((*[r[c] for c in cols], side, r["_blk"], _first(x, r[value], r[value] - r[drop])))
        return pd.DataFrame(rows, columns=names).astype({"ok": "Int32"})

    by = lambda d, *more: d.groupBy(*keys, *more)
    seen = materialise(by(samples, "_blk").cogroup(by(asks, "_blk")).applyInPandas(inside, schema), "peak-sides")
    settled, pending = seen.where("ok IS NOT NULL").drop("_home"), seen.where("ok IS NULL").drop("ok")

    extremes = by(samples, "_blk").agg(F.max("_v").alias("_mx"), F.min("_v").alias("_mn"))
    parts = pending.select(*keys, F.floor(F.col("_home") / GROUP).alias("_grp")).distinct()
    table = extremes.join(parts, keys)
    found_schema = _schema(asks, cols, "side int, _target bigint, ok int")

    def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, rows = a.sort_values("_blk"), []
        no, mx, mn = (a[c].to_numpy() for c in ("_blk", "_mx", "_mn"))
        for r in b.to_dict("records"):
            up, down = mx > r[value], mn <= r[value] - r[drop]
            beyond = (no < r["_home"]) if r["side"] < 0 else (no > r["_home"])
            hit = np.flatnonzero((up | down) & beyond)
            at = (hit[-1] if r["side"] < 0 else hit[0]) if len(hit) else None
            both = at is not None and up[at] and down[at]
            ok = None if both else int(at is not None and bool(down[at]))
            rows.append((*[r[c] for c in cols], r["side"], int(no[at]) if both else None, ok))
        return pd.DataFrame(rows, columns=[*cols, "side", "_target", "ok"]).astype({"ok": "Int32", "_target": "Int64"})

    asked = pending.withColumn("_grp", F.floor(F.col("_home") / GROUP))
    found = materialise(by(table, "_grp").cogroup(by(asked, "_grp")).applyInPandas(across, found_schema), "peak-blocks")
    last_schema = _schema(asks, cols, "side int, ok int")

    def detail(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        v = a.sort_values("_i")["_v"].to_numpy()
        rows = [(*[r[c] for c in cols], r["side"], _first(v[::-1] if r["side"] < 0 else v, r[value], r[value] - r[drop])) for r in b.to_dict("records")]
        return pd.DataFrame(rows, columns=[*cols, "side", "ok"]).astype({"ok": "Int32"})

    left = found.where("ok IS NULL").drop("ok").withColumnRenamed("_target", "_blk")
    need = samples.join(left.select(*keys, "_blk").distinct(), [*keys, "_blk"], "left_semi")
    deep = by(need, "_blk").cogroup(by(left, "_blk")).applyInPandas(detail, last_schema)
    sides = settled.unionByName(found.where("ok IS NOT NULL").drop("_target")).unionByName(deep)
    return sides.groupBy(*keys, index, value).agg(F.sum("ok").alias("_ok")).where("_ok = 2").drop("_ok")


def find_peaks(signal: DataFrame, keys: Sequence[str], index: str, value: str, distance: int = 300, prominence_std: float = 0.2, block: int = BLOCK) -> DataFrame:
    """Local maxima ``distance`` apart whose prominence is at least a share of the signal's deviation."""
    keys = list(keys)
    signal = materialise(signal.select(*keys, index, value), "signal")
    tops = keep_distance(local_maxima(signal, keys, index, value), keys, index, value, distance, block)
    drops = signal.groupBy(*keys).agg((F.stddev_pop(value) * prominence_std).alias("_drop"))
    return prominent(tops.join(drops, keys), signal, keys, index, value, "_drop", block)


def segments_between(peaks: DataFrame, keys: Sequence[str], index: str, min_len: int = 100) -> DataFrame:
    """Segments from peak to next peak with at least ``min_len`` samples."""
    d = ordered_columns(peaks, keys, [index], lead={"raw_end": index}).withColumn("raw_length", F.col("raw_end") - F.col(index))
    return d.where(F.col("raw_length") >= min_len).select(*keys, F.col(index).alias("raw_start"), "raw_end", "raw_length")


def weak_recordings(signal: DataFrame, segments: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """Rows of recordings for which the trigger gave fewer than ``least`` segments."""
    enough = segments.select(*keys, "segment").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= least)
    return signal.join(enough.drop("_c"), list(keys), "left_anti")
