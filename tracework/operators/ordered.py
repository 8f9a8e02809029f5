"""Ordered per-key columns that never gather a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one task; one recording may hold a third of the
data, and one clock value may hold most of a recording.  Large inputs are therefore shuffled once by ranges of the whole tuple
(keys, order), whose borders Spark samples itself.  One pass over each sorted range computes what the range alone can say and is
written down; what crosses a border (counts, sums, previous and next values) can only concern the first and the last key of a
range, so it travels through the first and last rows of the ranges: two rows per range, joined back by the range's number.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracework.session import materialise, rows_per_range

#: Bytes of input files that count as one row when nothing else is known before a plan has run; and when ranges are cut, as a task holds
#: its range and compressed rows of few columns are that small.
BYTES_PER_ROW, LEAST_BYTES = 64, 16
KINDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def range_count(df: DataFrame) -> int:
    """Number of ranges for an ordered pass over ``df``: about its rows by ``rowsPerRange``, 1 for a plain window.

    The rows are judged by the size of the files that the plan reads, so no job runs.  Only rows that the driver or an RDD
    holds, whose size no plan knows, are counted.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known, most = all(n < 1 << 62 for n in sizes), rows_per_range(df.sparkSession)
    rows = sum(sizes) // BYTES_PER_ROW if known else df.count()
    if known and rows > most:
        rows = sum(sizes) // LEAST_BYTES
    return max(1, -(-rows // most))


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    ranges: int | None = None,
    index: str | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,  # noqa: A002 - reads well at the call site
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    index     0-based position;           lag/lead  neighbour row's value
    running   inclusive running sum;      last/next nearest non-null at or before/after
    total     aggregate over the whole key; every aggregate must be a sum/count/min/max
              expression given as ``{out: (kind, column)}``.

    ``order`` must be a total order inside a key.  Null keys are a key of their own; null order values come first.
    ``ranges`` is the number of ranges, by default what ``range_count`` says; results do not depend on it.
    """
    wanted = {"lag": dict(lag or {}), "lead": dict(lead or {}), "running": dict(running or {}), "last": dict(last or {}), "next": dict(next or {})}
    total, keys, order = dict(total or {}), list(keys), list(order)
    ranges = range_count(df) if ranges is None else ranges
    if ranges <= 1:
        return _by_window(df, keys, order, index, wanted, total)
    return _by_ranges(df, keys, order, ranges, index, wanted, total)


def _by_window(df: DataFrame, keys: list[str], order: list[str], index: str | None, wanted: dict[str, dict[str, str]], total: dict) -> DataFrame:
    """One window per key."""
    parts = [F.col(k) for k in keys] or [F.lit(1)]
    w = Window.partitionBy(*parts).orderBy(*_order(order))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # "next" runs over the reversed order: a frame open to the end would rescan the rest for every row
    back = Window.partitionBy(*parts).orderBy(*[c.desc() for c in _order(order)])
    back = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sel = [(F.row_number().over(w) - 1).cast("long").alias(index)] if index else []
    sel += [F.lag(c).over(w).alias(out) for out, c in wanted["lag"].items()]
    sel += [F.lead(c).over(w).alias(out) for out, c in wanted["lead"].items()]
    sel += [F.sum(c).over(upto).alias(out) for out, c in wanted["running"].items()]
    sel += [F.last(c, ignorenulls=True).over(upto).alias(out) for out, c in wanted["last"].items()]
    sel += [F.last(c, ignorenulls=True).over(back).alias(out) for out, c in wanted["next"].items()]
    sel += [KINDS[kind](c).over(Window.partitionBy(*parts)).alias(out) for out, (kind, c) in total.items()]
    return df.select("*", *sel)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal, and so are NaNs."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    if pa.types.is_nested(column.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
    if pa.types.is_floating(column.type):
        same |= pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return ~same


def _running(column: pa.Array, starts: np.ndarray, start: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Running sum inside each group, null ahead of its first value."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(column, 0).cast(kind).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(kind):  # a group's sum must not carry another group's rounding
        sums = np.concatenate([np.cumsum(part) for part in np.split(values, starts[1:])])
    else:
        sums = np.cumsum(values)
        sums = sums - (sums[start] - values[start])
    seen = np.cumsum(valid)
    return pa.array(sums, mask=(seen - (seen[start] - valid[start])) == 0)


def _sorted_pass(names: list[str], keys: list[str], wanted: dict[str, dict[str, str]], doubles: set[str], kinds: dict[str, str]):
    """What one sorted range says by itself; a task holds its range, whose size is that of a shuffle partition."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        column = {c: table.column(c).chunk(0) for c in table.column_names}
        n = table.num_rows
        at = np.arange(n)
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= _changes(column[k])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        start = starts[group]
        end = np.append(starts[1:], n)[group] - 1
        got = {}
        for out, c in wanted["lag"].items():
            got[out] = column[c].take(pa.array(at - 1, mask=at == start))
        for out, c in wanted["lead"].items():
            got[out] = column[c].take(pa.array(at + 1, mask=at == end))
        for out, c in wanted["running"].items():
            got[out] = _running(column[c], starts, start, pa.float64() if out in doubles else pa.int64())
        for out, c in wanted["last"].items():
            seen = np.maximum.accumulate(np.where(column[c].is_valid().to_numpy(zero_copy_only=False), at, -1))
            got[out] = column[c].take(pa.array(seen, mask=seen < start))
        for out, c in wanted["next"].items():
            seen = np.minimum.accumulate(np.where(column[c].is_valid().to_numpy(zero_copy_only=False), at, n)[::-1])[::-1]
            got[out] = column[c].take(pa.array(seen, mask=seen > end))
        for out, kind in kinds.items():
            sides = pa.table({"g": group, "v": column[f"_t_{out}"]}).group_by("g", use_threads=False).aggregate([("v", kind)])
            got[out] = sides.column(f"v_{kind}").combine_chunks().take(pa.array(group))
        head, tail = group == 0, group == group[-1]
        got |= {"_ordinal": pa.array(at - start), "_range": pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), "_in_head": pa.array(head), "_in_tail": pa.array(tail),
                "_at_first": pa.array(at == 0), "_at_last": pa.array(at == n - 1)}
        yield from pa.table([*[column[c] for c in names], *got.values()], names=[*names, *got]).to_batches(max_chunksize=10_000)

    return run


def _by_ranges(df: DataFrame, keys: list[str], order: list[str], ranges: int, index: str | None, wanted: dict[str, dict[str, str]], total: dict) -> DataFrame:
    """One range shuffle, one sorted pass that is written down, and a table of two border rows per range."""
    rows = df.select("*", *[c.alias(f"_t_{out}") for out, (_, c) in total.items()])
    types = {f.name: f.dataType for f in rows.schema}
    source = {out: c for group in wanted.values() for out, c in group.items()}
    sums = {f.name: f.dataType for f in rows.select(*[F.sum(c).alias(out) for out, c in wanted["running"].items()], *[KINDS[k](f"_t_{o}").alias(o) for o, (k, _) in total.items()]).schema} if wanted["running"] or total else {}
    for out in wanted["running"]:
        if not isinstance(sums[out], T.LongType | T.DoubleType):
            raise TypeError(f"running sums are long or double, not {sums[out].simpleString()}")
    out_types = {out: sums.get(out) or types[c] for out, c in source.items()} | {out: sums[out] for out in total}
    marks = {"_ordinal": T.LongType(), "_range": T.IntegerType(), "_in_head": T.BooleanType(), "_in_tail": T.BooleanType(), "_at_first": T.BooleanType(), "_at_last": T.BooleanType()}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + [T.StructField(n, t) for n, t in (out_types | marks).items()])

    one_pass = _sorted_pass(df.columns, keys, wanted, {out for out, t in sums.items() if isinstance(t, T.DoubleType)}, {out: kind for out, (kind, _) in total.items()})
    place = [*[F.col(k) for k in keys], *_order(order)]
    local = materialise(rows.repartitionByRange(ranges, *place).sortWithinPartitions(*place).mapInArrow(one_pass, schema), "ordered")

    # the first and the last row of each range; a range of one row is both
    side = F.explode(F.array_compact(F.array(F.when(F.col("_at_first"), F.lit(0)), F.when(F.col("_at_last"), F.lit(1)))))
    edges = local.where("_at_first or _at_last").withColumn("_at_side", side)
    parts = [F.col(k) for k in keys] or [F.lit(1)]
    ended, begun = F.col("_at_side") == 1, F.col("_at_side") == 0
    before = Window.partitionBy(*parts).orderBy("_range", "_at_side").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parts).orderBy(F.col("_range").desc(), F.col("_at_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    cell = lambda c: F.struct(F.col(c).alias("v"))  # noqa: E731 - keeps a null value apart from no row
    ahead = [F.sum(F.when(ended, F.col("_ordinal") + 1)).over(before).alias("_offset")]
    ahead += [F.last(F.when(ended, cell(c)), ignorenulls=True).over(before).alias(out) for out, c in wanted["lag"].items()]
    ahead += [F.sum(F.when(ended, F.col(out))).over(before).alias(out) for out in wanted["running"]]
    ahead += [F.last(F.when(ended, F.col(out)), ignorenulls=True).over(before).alias(out) for out in wanted["last"]]
    behind = [F.lit(0).alias("_none")]
    behind += [F.last(F.when(begun, cell(c)), ignorenulls=True).over(after).alias(out) for out, c in wanted["lead"].items()]
    behind += [F.last(F.when(begun, F.col(out)), ignorenulls=True).over(after).alias(out) for out in wanted["next"]]
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    once = ended | ~F.col("_in_tail")  # a range inside one key tells its total once
    sums_all = [merge[kind](F.when(once, F.col(out))).over(whole).alias(out) for out, (kind, _) in total.items()]
    carried = edges.select("_range", "_at_side", F.struct(*ahead).alias("_ahead"), F.struct(*behind).alias("_behind"), F.struct(F.lit(0).alias("_none"), *sums_all).alias("_whole"))
    pick = lambda c, side: F.first(F.when(side, F.col(c)), ignorenulls=True)
    borders = carried.groupBy("_range").agg(pick("_ahead", begun).alias("_ahead"), pick("_behind", ended).alias("_behind"), pick("_whole", begun).alias("_wa"), pick("_whole", ended).alias("_wb"))

    joined = local.join(borders, "_range", "left")
    head, tail = F.col("_in_head"), F.col("_in_tail")
    outs = [F.col(f"`{c}`") for c in df.columns]
    if index:
        outs.append((F.col("_ordinal") + F.when(head, F.coalesce("_ahead._offset", F.lit(0))).otherwise(0)).cast("long").alias(index))
    for out in wanted["lag"]:
        outs.append(F.when(head & (F.col("_ordinal") == 0), F.col(f"_ahead.{out}.v")).otherwise(F.col(out)).alias(out))
    for out in wanted["lead"]:
        outs.append(F.when(F.col("_at_last"), F.col(f"_behind.{out}.v")).otherwise(F.col(out)).alias(out))
    for out in wanted["running"]:
        carry = F.when(head, F.col(f"_ahead.{out}"))
        outs.append(F.coalesce(F.col(out) + carry, F.col(out), carry).alias(out))
    for out in wanted["last"]:
        outs.append(F.coalesce(F.col(out), F.when(head, F.col(f"_ahead.{out}"))).alias(out))
    for out in wanted["next"]:
        outs.append(F.coalesce(F.col(out), F.when(tail, F.col(f"_behind.{out}"))).alias(out))
    for out in total:
        outs.append(F.when(head, F.col(f"_wa.{out}")).when(tail, F.col(f"_wb.{out}")).otherwise(F.col(out)).alias(out))
    return joined.select(*outs)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key for groups of any size.

    Equal values are counted first (map-side), then positions come from running
    counts over value ranges, so no task holds a whole group.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    pos = ordered_columns(counts, keys, [value], running={"_hi": "_c"}, total={"_t": ("sum", F.col("_c"))})
    lo = F.col("_hi") - F.col("_c")  # positions lo .. hi-1 hold this value
    aggs = []
    for out, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_t") - 1)
        base = F.floor(rank)
        top = F.least(base + 1, F.col("_t") - 1)
        at = lambda i: (i >= lo) & (i < F.col("_hi"))
        aggs += [
            F.max(F.when(at(base), F.col(value))).alias(f"_a_{out}"),
            F.max(F.when(at(top), F.col(value))).alias(f"_b_{out}"),
            F.max(rank - base).alias(f"_f_{out}"),
        ]
    got = pos.groupBy(*keys).agg(*aggs) if keys else pos.agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"_a_{o}") + (F.col(f"_b_{o}") - F.col(f"_a_{o}")) * F.col(f"_f_{o}")).alias(o)
            for o in probs
        ],
    )


def group_mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key, smallest on ties; counts are pre-aggregated."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    top = counts.groupBy(*keys).agg(F.max("_c").alias("_m"))
    picked = counts.join(top, list(keys)) if keys else counts.where(F.col("_c") == top.scalar())
    if keys:
        picked = picked.where(F.col("_c") == F.col("_m"))
    return picked.groupBy(*keys).agg(F.min(value).alias(out))
