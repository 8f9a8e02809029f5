"""Exploration of the given tables."""
from pyspark.sql import functions as F

from tracework.functions.numeric import correlation
from tracework.operators import aggregates as a
from tracework.operators import explore as ex
from tracework.operators.ordered import group_quantiles
from tracework.plans.registry import outputs, query

TABLES = ("customer", "orders", "lineitem", "events", "labels")


@query("exp_list_datasets")
def _(t):
    return ex.list_datasets(t.spark, t.dir)


@query("exp_cache_datasets")
def _(t):
    cache = ex.DatasetCache(t.spark)
    rows = []
    for name in ("customer", "orders", "customer"):
        status = cache.load(name, f"{t.dir}/{name}.parquet")
        rows.append((name, status, cache.get(name).count()))
    cache.clear()
    return t.spark.createDataFrame(rows, "name string, status string, n long")


@query("exp_summaries")
def _(t):
    return ex.summaries(t.spark, {n: getattr(t, n) for n in TABLES})


@query("exp_call_method", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) + 0.0 AS min, round(max({c}), 4) + 0.0 AS max,
 round(quantile_cont({c}, 0.25), 4) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 4) + 0.0 AS p50, round(quantile_cont({c}, 0.75), 4) + 0.0 AS p75 FROM (SELECT {c}::DOUBLE AS {c} FROM customer)""" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def _(t):
    return outputs(ex.call_method(t.customer, "describe", "c_custkey"), 4)


@query("exp_call_head", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5")
def _(t):
    return ex.call_method(t.customer.select("c_custkey", "c_name", "c_acctbal"), "head", "c_custkey")


@query("exp_group_count", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("exp_group_avg", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def _(t):
    return outputs(t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean")), 4)


@query("exp_box_by_level", """
SELECT p_size, round(quantile_cont(p_retailprice, 0), 4) AS low, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.5), 4) AS median,
 round(quantile_cont(p_retailprice, 0.75), 4) AS q3, round(quantile_cont(p_retailprice, 1), 4) AS high FROM part GROUP BY 1""")
def _(t):
    return outputs(group_quantiles(t.part, ["p_size"], "p_retailprice", {"low": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1}), 4)


@query("exp_corr_pairs", "SELECT 'l_quantity' AS predictor, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6) FROM lineitem")
def _(t):
    m = a.long_features(t.lineitem.withColumn("y", F.col("l_extendedprice")), ["y"], ["l_quantity", "l_discount"])
    return outputs(m.groupBy(F.col("feature").alias("predictor")).agg(correlation("value", "y").alias("r")))


@query("exp_group_effect", """
WITH x AS (SELECT n_regionkey, c_acctbal, (c_mktsegment = 'BUILDING')::INTEGER AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_regionkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(corr(flag, c_acctbal), 6) AS r_flag,
 round((avg(c_acctbal) FILTER (flag = 1) - avg(c_acctbal) FILTER (flag = 0)) / sqrt(0.5 * (var_pop(c_acctbal) FILTER (flag = 1) + var_pop(c_acctbal) FILTER (flag = 0))), 6) AS effect FROM x GROUP BY 1""")
def _(t):
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("flag", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    y, on, off = F.col("c_acctbal"), F.when(F.col("flag") == 1, F.col("c_acctbal")), F.when(F.col("flag") == 0, F.col("c_acctbal"))
    effect = (F.avg(on) - F.avg(off)) / F.sqrt(0.5 * (F.var_pop(on) + F.var_pop(off)))
    g = x.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), correlation("flag", y).alias("r_flag"), effect.alias("effect"))
    return outputs(g, 6, mean=4)
