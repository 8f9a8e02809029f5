"""Column builders for numeric expressions used across operators."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round half away from zero on the scaled double; also turns -0.0 into 0.0."""
    scale = float(10**digits)
    return F.round(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def norm(*cols: Column | str) -> Column:
    """Euclidean length of a vector given by its component columns."""
    return F.sqrt(reduce(lambda a, b: a + b, [col(c) * col(c) for c in cols]))


def finite(c: Column | str) -> Column:
    """True where the value is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the rows that have both values; null where a side is constant.

    The built-in aggregate divides before a surrounding condition is asked, and a division by zero ends the job.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread != 0, F.covar_pop(x, y) / F.when(spread != 0, spread))


def adjusted_skew(n: Column, skew_pop: Column) -> Column:
    """Bias-adjusted sample skewness G1 from the population skewness."""
    n = n.cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * skew_pop)


def adjusted_kurtosis(n: Column, kurt_pop: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 from the population excess kurtosis."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt_pop + 6))


def log_bin(c: Column | str, low: float, high: float, bins: int) -> Column:
    """0-based bin of a value on logarithmic edges; null outside [low, high)."""
    c = col(c)
    step = F.lit((math.log(high) - math.log(low)) / bins)
    idx = F.floor((F.ln(c) - F.lit(math.log(low))) / step)
    return F.when((c >= low) & (c < high), F.least(idx, F.lit(bins - 1)).cast("int"))


def linear_bin(c: Column | str, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, last bin closed on the right; null outside."""
    c = col(c)
    idx = F.floor((c - low) / (high - low) * bins).cast("int")
    return F.when((c >= low) & (c <= high), F.least(idx, F.lit(bins - 1)))
