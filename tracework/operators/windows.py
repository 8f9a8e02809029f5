"""Count, time and gap windows, trigger segments, ranking and centred windows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.operators.ordered import ordered_columns, range_count
from tracework.operators.quality import with_group_stats

LIVE_WINDOW = 50
BLOCK = 65_536


def _indexed(df, keys, order):
    return ordered_columns(df, keys, order, index="_i", total={"_n": ("count", F.lit(1))})


def count_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  size: int = LIVE_WINDOW) -> DataFrame:
    """Full windows of ``size`` rows per key; the incomplete tail is dropped."""
    d = _indexed(df, keys, order)
    full = F.col("_n") - F.col("_n") % size
    return d.where(F.col("_i") < full).withColumn(
        "window_id", F.floor(F.col("_i") / size).cast("long")
    ).drop("_i", "_n")


def fixed_number_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                         num: int) -> DataFrame:
    """Window size n // num per key (an error if 0 there), tail dropped: at least ``num`` windows."""
    d = _indexed(df, keys, order).withColumn("_size", F.floor(F.col("_n") / num).cast("long"))
    d = d.withColumn("_size", F.when(F.col("_size") > 0, F.col("_size")).otherwise(
        F.raise_error(F.lit("fewer rows than windows")).cast("long")))
    full = F.col("_n") - F.col("_n") % F.col("_size")
    return d.where(F.col("_i") < full).withColumn(
        "window_id", F.floor(F.col("_i") / F.col("_size")).cast("long")
    ).drop("_i", "_n", "_size")


def tumbling(df: DataFrame, keys: Sequence[str], clock: str, width: int) -> DataFrame:
    """Windows [k*width, (k+1)*width) counted from the key's first clock value."""
    return with_group_stats(df, keys, F.min(clock).alias("_t0")).withColumn(
        "window_id", F.floor((F.col(clock) - F.col("_t0")) / width).cast("long")
    ).drop("_t0")


def gap_sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: int) -> DataFrame:
    """New group where the step to the previous clock value is larger than ``gap``."""
    clock = order[0]
    ranges = range_count(df)
    d = ordered_columns(df, keys, order, ranges=ranges, lag={"_prev": clock})
    d = d.withColumn("_new", F.when(F.col(clock) - F.col("_prev") > gap, 1).otherwise(0)).drop("_prev")
    return ordered_columns(d, keys, order, ranges=ranges, running={"session": "_new"}).drop("_new")


def rising_edge_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                         trigger: str) -> DataFrame:
    """Rows between consecutive rising edges of the trigger, numbered from 0 per key.

    Threshold is the middle of the key's trigger range; the sample before the rise
    belongs to the new segment; what follows the last edge stays open and is dropped.
    """
    ranges = range_count(df)
    d = with_group_stats(df, keys, ((F.max(trigger) + F.min(trigger)) * 0.5).alias("_thr"))
    d = ordered_columns(d, keys, order, ranges=ranges, index="i", lead={"_next": trigger})
    rise = (F.col(trigger) <= F.col("_thr")) & (F.col("_next") > F.col("_thr"))
    d = d.withColumn("_edge", F.when(rise, 1).otherwise(0)).drop("_thr", "_next")
    d = ordered_columns(d, keys, order, ranges=ranges, running={"_seg": "_edge"},
                        total={"_edges": ("sum", F.col("_edge"))})
    return d.where((F.col("_seg") >= 1) & (F.col("_seg") < F.col("_edges"))).withColumn(
        "segment", (F.col("_seg") - 1).cast("long")
    ).drop("_seg", "_edges", "_edge")


def min_length(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with at least n rows."""
    keep = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= n)
    return df.join(keep.drop("_c"), list(keys), "left_semi")


def margin_slice(df: DataFrame, bounds: DataFrame, keys: Sequence[str], index: str,
                 margin: int) -> DataFrame:
    """Raw rows from ``margin`` before a segment's start to ``margin`` after its end.

    ``bounds`` has one row per key (the segment looked at): keys, start, end.
    """
    b = bounds.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    return df.join(b, list(keys)).where(
        (F.col(index) >= F.col("_s") - margin) & (F.col(index) < F.col("_e") + margin)
    ).drop("_s", "_e")


def top_k(df: DataFrame, score: str, k: int, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """k rows with the highest score, overall or per key (pruned before the shuffle)."""
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in a defined order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def global_id(df: DataFrame, state: str, order: Sequence[str], out: str = "global_id") -> DataFrame:
    """'<state>_000000' ids in file order."""
    d = ordered_columns(df, [state], order, index="_i")
    return d.withColumn(out, F.format_string("%s_%06d", F.col(state), F.col("_i"))).drop("_i")


def limit_per_item(df: DataFrame, item: str, order: Sequence[str], per_item: int = 3,
                   overall: int = 10) -> DataFrame:
    """At most ``per_item`` rows per item, then the first ``overall`` in item order (a report)."""
    w = Window.partitionBy(item).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_item)
    return ranked.orderBy(item, "rank").limit(overall)


def centred(df: DataFrame, keys: Sequence[str], index: str, half: int,
            aggs: Mapping[str, Column], block: int = BLOCK) -> DataFrame:
    """Aggregates over rows i-half .. i+half per key, split into index blocks.

    Rows near a block border are copied to the neighbour block, so the window runs per
    (key, block) and a long key is spread over many tasks.  ``index`` counts 0,1,2,..
    per key and ``half`` must not exceed ``block``.
    """
    if half > block:
        raise ValueError("half window larger than block")
    own = F.floor(F.col(index) / block)
    copies = F.array_distinct(F.array(
        F.floor((F.col(index) - half) / block), own, F.floor((F.col(index) + half) / block)))
    d = df.withColumn("_own", own).withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(-half, half)
    cols = {out: (agg(w) if callable(agg) else agg.over(w)) for out, agg in aggs.items()}
    return d.withColumns(cols).where(F.col("_own") == F.col("_blk")).drop("_own", "_blk")


def moving_average(df: DataFrame, keys: Sequence[str], index: str, value: str, width: int,
                   out: str = "smooth") -> DataFrame:
    """Box filter of odd width with zero padding: sum of present neighbours / width."""
    if width <= 1:
        return df.withColumn(out, F.col(value))
    width += 1 - width % 2
    d = centred(df, keys, index, width // 2, {out: F.sum(value)})
    return d.withColumn(out, F.col(out) / width)


def half_width(n: Column, share: float = 0.08, least: int = 7) -> Column:
    """Half of an odd window that covers ``share`` of ``n`` points, at least ``least`` of them."""
    return F.greatest(F.floor(F.round(n * share) / 2), F.lit(least // 2)).cast("long")


def sliding_slope(df: DataFrame, keys: Sequence[str], index: str, x: str, y: str, half: int | Column,
                  min_points: int = 5) -> DataFrame:
    """Least-squares slope of y on x in a full centred window; null at the edges.

    Sums over a window are differences of running sums, looked up ``half`` rows ahead and ``half + 1`` behind, so a window may be of any
    width at the same cost.  ``half`` may be a column that is constant per key; ``index`` counts 0, 1, 2, .. per key.  Values are taken
    relative to their overall means, which keeps the running sums small and changes no slope.
    """
    keys = list(keys)
    means = df.agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y"))).scalar()
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    own = F.struct(*df.columns).alias("_own")
    d = df.select(*keys, F.col(index).cast("long").alias("_i"), own, (half if isinstance(half, Column) else F.lit(half)).cast("long").alias("_h"),
                  both.cast("long").alias("_one"), F.when(both, F.col(x)).alias("_xv"), F.when(both, F.col(y)).alias("_yv")).withColumn("_m", means)
    xc, yc = F.coalesce(F.col("_xv") - F.col("_m.x"), F.lit(0.0)), F.coalesce(F.col("_yv") - F.col("_m.y"), F.lit(0.0))
    d = d.select(*keys, "_i", "_own", "_h", "_one", xc.alias("_x"), yc.alias("_y"), (xc * xc).alias("_xx"), (xc * yc).alias("_xy"))
    sums = ("_one", "_x", "_y", "_xx", "_xy")
    d = ordered_columns(d, keys, ["_i"], running={f"{c}s": c for c in sums})
    # each row stands for itself and lends its running sums to the two centres whose windows end or begin here
    places = F.array(*[F.struct(at.alias("at"), F.lit(role).alias("role")) for role, at in enumerate((F.col("_i"), F.col("_i") - F.col("_h"), F.col("_i") + F.col("_h") + 1))])
    d = d.withColumn("_p", F.explode(places))
    role, upto = F.col("_p.role"), F.struct(*[F.col(f"{c}s").alias(c) for c in sums])
    pick = lambda c, r: F.first(F.when(role == r, c), ignorenulls=True)
    met = d.groupBy(*keys, F.col("_p.at").alias("_at")).agg(
        pick(F.struct("_own", "_h"), 0).alias("_row"), pick(upto, 1).alias("_to"), pick(upto, 2).alias("_from")).where("_row IS NOT NULL")
    n, sx, sy, sxx, sxy = (F.col(f"_to.{c}") - F.coalesce(F.col(f"_from.{c}"), F.lit(0)) for c in sums)
    den = n * sxx - sx * sx
    ok = F.col("_to").isNotNull() & (F.col("_at") >= F.col("_row._h")) & (n >= min_points) & (den > 1e-12 * n * sxx)
    return met.select("_row._own.*", F.when(ok, (n * sxy - sx * sy) / den).alias("slope"))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Contiguous runs of true ``flag`` rows: keys, run, start, end, length (by index i)."""
    ranges = range_count(df)
    d = ordered_columns(df, keys, order, ranges=ranges, index="_i", lag={"_pf": flag})
    opens = F.col(flag) & ~F.coalesce(F.col("_pf"), F.lit(False))
    d = d.withColumn("_open", F.when(opens, 1).otherwise(0)).drop("_pf")
    d = ordered_columns(d, keys, order, ranges=ranges, running={"run": "_open"})
    return d.where(F.col(flag)).groupBy(*keys, "run").agg(
        F.min("_i").alias("start"), F.max("_i").alias("end"), F.count(F.lit(1)).alias("length")
    )


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Longest run per key, the earliest one on ties."""
    r = runs(df, keys, order, flag)
    best = F.max_by(F.struct("start", "end", "length"),
                    F.struct(F.col("length"), -F.col("start"))).alias("b")
    return (r.groupBy(*keys).agg(best) if keys else r.agg(best)).select(*keys, "b.*")


def first_long_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str,
                   min_len: int = 12) -> DataFrame:
    r = runs(df, keys, order, flag).where(F.col("length") >= min_len)
    best = F.min_by(F.struct("start", "end", "length"), "start").alias("b")
    return (r.groupBy(*keys).agg(best) if keys else r.agg(best)).select(*keys, "b.*")


def differences(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First difference and sign change against the previous row."""
    d = ordered_columns(df, keys, order, lag={"_p": value})
    return d.withColumn("diff", F.col(value) - F.col("_p")).withColumn(
        "sign_change",
        F.when(F.col("_p").isNotNull(), (F.signum(value) != F.signum("_p")).cast("int")),
    ).drop("_p")


def stitch(df: DataFrame, session: str, groups: Mapping[str, Sequence], out: str) -> DataFrame:
    """Map sessions of the same tool to one recording name."""
    c = F.col(session).cast("string")
    expr = None
    for name, members in groups.items():
        cond = F.col(session).isin(list(members))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return df.withColumn(out, expr.otherwise(c) if expr is not None else c)
