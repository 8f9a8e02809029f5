"""Time-domain features on (part, channel) series."""

from tracework.operators import features_time as ft
from tracework.plans.registry import outputs, query

KEYS, ORD = ["part", "channel"], ["us", "event_id"]

BASE = """WITH s AS (SELECT user_id AS part, event_type AS channel, value AS v,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n,
 avg(value) OVER (PARTITION BY user_id, event_type) AS m,
 lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)
"""
CNT = BASE.rstrip() + ", c AS (SELECT part, channel, v, count(*) AS c FROM s GROUP BY 1, 2, 3)\n"
RUN = BASE.rstrip() + """, r0 AS (SELECT *, sign(v - m) AS sd, lag(sign(v - m)) OVER (PARTITION BY part, channel ORDER BY i) AS ps FROM s),
r1 AS (SELECT *, sum(CASE WHEN ps = sd THEN 0 ELSE 1 END) OVER (PARTITION BY part, channel ORDER BY i) AS run FROM r0),
r AS (SELECT part, channel, run, sd, count(*) AS len FROM r1 GROUP BY ALL)
"""
MOM = BASE.rstrip() + """, z AS (SELECT part, channel, count(*) AS n, avg((v-m)*(v-m)) AS m2, avg((v-m)*(v-m)*(v-m)) AS m3, avg((v-m)*(v-m)*(v-m)*(v-m)) AS m4 FROM s GROUP BY 1, 2)
"""
BEN = BASE.rstrip() + """, d AS (SELECT part, channel, floor(abs(v) / power(10.0::DOUBLE, floor(log10(abs(v)))) + 1e-9::DOUBLE) AS d FROM s WHERE abs(v) > 0),
b AS (SELECT part, channel, x.d AS d, count(*) FILTER (d.d = x.d) / count(*) AS share, log10(1.0::DOUBLE + 1.0::DOUBLE / x.d) AS law
 FROM d, (SELECT unnest(range(1, 10)) AS d) x GROUP BY part, channel, x.d)
"""
# means over 8, 16, .. values end exactly on a rounding tie; a small shift on both sides decides it
NUDGE = 2.5e-10
TIED = ("variance", "linear_trend_slope", "linear_trend_intercept")


def agg(base, expr, table="s"):
    return lambda n: f"{base}SELECT part, channel, {expr} AS {n} FROM {table} GROUP BY 1, 2"


R = lambda e, d=6: f"round({e}, {d}) + 0.0"
SQL = {
    "abs_energy": agg(BASE, R("sum(v*v)", 4)), "absolute_maximum": agg(BASE, R("max(abs(v))", 4)), "length": agg(BASE, "count(v)"),
    "maximum": agg(BASE, R("max(v)", 4)), "minimum": agg(BASE, R("min(v)", 4)), "mean": agg(BASE, R("avg(v)", 4)), "sum_values": agg(BASE, R("sum(v)", 4)),
    "root_mean_square": agg(BASE, R("sqrt(avg(v*v))", 4)), "standard_deviation": agg(BASE, R("stddev_pop(v)", 4)), "variance": agg(BASE, R("var_pop(v) + 2.5e-10::DOUBLE", 6)),
    "skewness": agg(MOM, R("max(CASE WHEN n > 2 AND m2 > 0 THEN sqrt(n*(n-1.0::DOUBLE))/(n-2)*m3/power(m2,1.5) END)", 4), "z"),
    "kurtosis": agg(MOM, R("max(CASE WHEN n > 3 AND m2 > 0 THEN (n-1.0::DOUBLE)/((n-2)*(n-3))*((n+1)*(m4/(m2*m2)-3)+6) END)", 4), "z"),
    "variance_larger_than_standard_deviation": agg(BASE, "var_pop(v) > stddev_pop(v)"),
    "variation_coefficient": agg(BASE, R("CASE WHEN avg(v) <> 0 THEN stddev_pop(v)/avg(v) END", 4)),
    "absolute_sum_of_changes": agg(BASE, R("coalesce(sum(abs(v-p)), 0)", 4)), "mean_abs_change": agg(BASE, R("avg(abs(v-p))", 4)),
    "mean_change": agg(BASE, R("CASE WHEN max(n) > 1 THEN (arg_max(v, i) - arg_min(v, i)) / (max(n) - 1) END", 4)),
    "mean_second_derivative_central": agg(BASE, R(
        "CASE WHEN max(n) > 2 THEN (max(v) FILTER (i = n-1) - max(v) FILTER (i = n-2) - max(v) FILTER (i = 1) + max(v) FILTER (i = 0)) / (2*(max(n)-2)) END", 4)),
    "first_location_of_maximum": agg(BASE, R("arg_max(i, (v, -i)) / count(*)", 4)), "first_location_of_minimum": agg(BASE, R("arg_min(i, (v, i)) / count(*)", 4)),
    "last_location_of_maximum": agg(BASE, R("(arg_max(i, (v, i)) + 1) / count(*)", 4)), "last_location_of_minimum": agg(BASE, R("(arg_min(i, (v, -i)) + 1) / count(*)", 4)),
    "count_above_mean": agg(BASE, "count(*) FILTER (v > m)"), "count_below_mean": agg(BASE, "count(*) FILTER (v < m)"),
    "longest_strike_above_mean": agg(RUN, "coalesce(max(len) FILTER (sd = 1), 0)", "r"), "longest_strike_below_mean": agg(RUN, "coalesce(max(len) FILTER (sd = -1), 0)", "r"),
    "has_duplicate": agg(CNT, "max(c) > 1", "c"), "has_duplicate_max": agg(CNT, "arg_max(c, v) > 1", "c"), "has_duplicate_min": agg(CNT, "arg_min(c, v) > 1", "c"),
    "percentage_of_reoccurring_datapoints_to_all_datapoints": agg(CNT, R("coalesce(sum(c) FILTER (c > 1), 0) / sum(c)", 4), "c"),
    "percentage_of_reoccurring_values_to_all_values": agg(CNT, R("count(*) FILTER (c > 1) / count(*)", 4), "c"),
    "ratio_value_number_to_time_series_length": agg(CNT, R("count(*) / sum(c)", 4), "c"),
    "sum_of_reoccurring_data_points": agg(CNT, R("coalesce(sum(v * c) FILTER (c > 1), 0)", 4), "c"),
    "sum_of_reoccurring_values": agg(CNT, R("coalesce(sum(v) FILTER (c > 1), 0)", 4), "c"),
    "median": agg(BASE, R("median(v)", 4)), "benford_correlation": agg(BEN, R("CASE WHEN stddev_pop(share) > 0 THEN corr(share, law) END", 4), "b"),
    "linear_trend_slope": agg(BASE, R("regr_slope(v, i) + 2.5e-10::DOUBLE", 6)), "linear_trend_intercept": agg(BASE, R("regr_intercept(v, i) + 2.5e-10::DOUBLE", 6)),
    "linear_trend_rvalue": agg(BASE, R("CASE WHEN count(*) > 1 THEN CASE WHEN stddev_pop(v) > 0 THEN corr(v, i) ELSE 0 END END", 4)),
    "linear_trend_stderr": agg(BASE, R("""CASE WHEN count(*) > 2 THEN sqrt(greatest(1 - CASE WHEN stddev_pop(v) > 0 THEN corr(v, i)*corr(v, i) ELSE 0 END, 0)
 * var_pop(v) / var_pop(i) / (count(*) - 2)) WHEN count(*) = 2 THEN 0 END""", 4)),
}


def _register(family, name):
    @query(f"ftd_{name}", SQL[name](name))
    def _(t):
        d = family(t.series, KEYS, ORD, "v").select(*KEYS, name)
        if name in TIED:
            return outputs(d, 6, nudge=NUDGE)
        return outputs(d, 4)


for _family, _names in ft.FAMILIES.items():
    for _name in _names:
        _register(_family, _name)


@query("ftd_linear_trend_pvalue")
def _(t):
    return outputs(ft.linear_trend(t.series, KEYS, ORD, "v", pvalue=True).select(*KEYS, "linear_trend_pvalue"))
