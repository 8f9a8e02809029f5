"""Row-level projections, gates and quality rules."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.functions.numeric import col, finite

# Default stroke limits and the live position gate.
MIN_STROKE = 1000
MAX_STROKE = 20000
FLAT_RANGE = 1e-6
MAX_AMPLITUDE = 1e6
LIVE_GATE = 42062.0
AIR_DENSITY = 1.225


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach per-key aggregates: pre-aggregated, then an equi-join that AQE may split."""
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, list(keys))


def depth_gate(df: DataFrame, depth: str, factor: float = 0.975) -> DataFrame:
    """Keep rows at or above ``factor`` times the global maximum depth."""
    top = df.agg(F.max(depth)).scalar()
    return df.where(F.col(depth) >= F.lit(factor) * top)


def fixed_gate(df: DataFrame, depth: str, threshold: float = LIVE_GATE) -> DataFrame:
    return df.where(F.col(depth) >= F.lit(threshold))


def fill_non_finite(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(finite(c), F.col(c)).otherwise(F.lit(value)) for c in cols})


def drop_non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.where(finite(c))
    return df


def elapsed(df: DataFrame, keys: Sequence[str], clock: str, out: str = "elapsed") -> DataFrame:
    """Clock minus the first clock value of the recording."""
    return with_group_stats(df, keys, F.min(clock).alias("_first")).withColumn(
        out, F.col(clock) - F.col("_first")
    ).drop("_first")


def quality_rules(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    min_len: int = MIN_STROKE,
    max_len: int = MAX_STROKE,
    flat: float = FLAT_RANGE,
    amplitude: float = MAX_AMPLITUDE,
) -> DataFrame:
    """One row per stroke: length, validity and the failed rules joined by ';'."""
    bad = [F.sum(F.when(finite(c), 0).otherwise(1)).alias(f"_bad_{c}") for c in channels]
    span = [
        (F.max(F.when(finite(c), F.col(c))) - F.min(F.when(finite(c), F.col(c)))).alias(f"_span_{c}")
        for c in channels
    ]
    peak = [F.max(F.when(finite(c), F.abs(F.col(c)))).alias(f"_peak_{c}") for c in channels]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_length"), *bad, *span, *peak)
    every = lambda cs: F.array_max(F.array(*cs))
    reasons = F.concat_ws(
        ";",
        F.when(F.col("raw_length") < min_len, "too_short"),
        F.when(F.col("raw_length") > max_len, "too_long"),
        F.when(every([F.col(f"_bad_{c}") for c in channels]) > 0, "non_finite_values"),
        F.when(every([F.col(f"_span_{c}") for c in channels]) < flat, "all_channels_flat"),
        F.when(every([F.col(f"_peak_{c}") for c in channels]) > amplitude, "unrealistic_amplitude"),
    )
    return g.select(
        *keys,
        "raw_length",
        (reasons == "").alias("valid"),
        F.when(reasons == "", "valid").otherwise(reasons).alias("quality_reason"),
    )


def hash_order(id_col: Column | str, seed: int) -> Column:
    """Deterministic pseudo-random sort key of a row id."""
    return F.md5(F.concat_ws(":", col(id_col).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in reproducible random order (a sampling operator: the limit is the feature)."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows with their reproducible shuffle key, globally ordered by it."""
    return df.withColumn("shuffle_key", hash_order(id_col, seed)).orderBy("shuffle_key", id_col)


def wall_units(
    df: DataFrame, y: str, u: str, u_tau: float, nu: float, y_wall: float = 0.0,
    y_plus_max: float = float("inf"),
) -> DataFrame:
    yp = F.lit(u_tau) * (F.col(y) - F.lit(y_wall)) / F.lit(nu)
    out = df.withColumn("y_plus", yp).withColumn("u_plus", F.col(u) / F.lit(u_tau))
    return out.where((F.col("y_plus") > 0) & (F.col("y_plus") <= F.lit(y_plus_max)))


def friction_velocity(tau: Column, rho: float = AIR_DENSITY) -> Column:
    return F.sqrt(F.abs(tau) / F.lit(rho))


def tke_budget(df: DataFrame, grad: dict[str, str], stress: dict[str, str], k_res: str,
               k_mod: str, eps_res: str, eps_mod: str) -> DataFrame:
    """Totals, production (nine terms, and the parts 11, 22, 33, 12) and its relation to eps.

    ``grad`` maps 'ij' (nine entries) and ``stress`` 'ij' with i <= j (six) to columns.
    """
    sym = lambda ij: stress.get(ij) or stress[ij[::-1]]
    term = {ij: F.col(g) * F.col(sym(ij)) for ij, g in grad.items()}
    production = -sum(term[ij] for ij in sorted(term))
    df = df.withColumns({
        "k_total": F.col(k_res) + F.col(k_mod),
        "eps_total": F.col(eps_res) + F.col(eps_mod),
        "production": production,
        "p11": -term["11"], "p22": -term["22"], "p33": -term["33"], "p12": -term["12"],
    })
    return df.withColumns({
        "prod_times_eps": F.col("production") * F.col("eps_total"),
        "prod_over_eps": F.when(F.col("eps_total") != 0, F.col("production") / F.col("eps_total")),
    })


def turbulence_intensity(df: DataFrame, diagonal: Sequence[str], u_tau: float) -> DataFrame:
    for c in diagonal:
        df = df.withColumn(f"{c}_plus", F.col(c) / F.lit(u_tau * u_tau)).withColumn(
            f"{c}_rms", F.sqrt(F.col(c))
        )
    return df


def resolved_k(diagonal: Sequence[str], k_sgs: str) -> Column:
    """Half the trace of the Reynolds stress plus the sub-grid part."""
    return F.lit(0.5) * sum(F.col(c) for c in diagonal) + F.col(k_sgs)


def wall_distance(df: DataFrame, y: str, z: str, u_tau: float, nu: float) -> DataFrame:
    """Distance to the nearest of four walls, also in wall units; extents are one scalar row."""
    ext = df.agg(
        F.struct(
            F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(z).alias("z0"), F.max(z).alias("z1")
        )
    ).scalar()
    return (
        df.withColumn("_e", ext)
        .withColumn("dy", F.least(F.col(y) - F.col("_e.y0"), F.col("_e.y1") - F.col(y)))
        .withColumn("dz", F.least(F.col(z) - F.col("_e.z0"), F.col("_e.z1") - F.col(z)))
        .withColumn("d", F.least("dy", "dz"))
        .withColumn("d_plus", F.col("d") * F.lit(u_tau / nu))
        .drop("_e")
    )
