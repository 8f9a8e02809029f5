"""Data set exploration."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of every repeated column name."""
    names, keep = df.columns, []
    unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    for i, n in enumerate(names):
        if n not in names[:i]:
            keep.append(F.col(f"c{i}").alias(n))
    return unique.select(*keep)


def list_datasets(spark, path: str, kind: str = "parquet") -> DataFrame:
    """Data files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


class DatasetCache:
    """Named data sets loaded once and kept by Spark."""

    def __init__(self, spark):
        self.spark, self._seen = spark, {}

    def load(self, name: str, path: str) -> str:
        if name in self._seen:
            return "cached"
        self._seen[name] = self.spark.read.parquet(path)
        self._seen[name].createOrReplaceTempView(name)
        self.spark.catalog.cacheTable(name)
        return "loaded"

    def get(self, name: str) -> DataFrame:
        return self._seen[name]

    def clear(self) -> None:
        for name in self._seen:
            self.spark.catalog.uncacheTable(name)
            self.spark.catalog.dropTempView(name)
        self._seen = {}


def summaries(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns and types of every data set."""
    rows = [(n, i, c, t) for n, d in tables.items() for i, (c, t) in enumerate(d.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, dtype string")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]


def describe_numeric(df: DataFrame) -> DataFrame:
    """count, mean, std, quartiles and extremes of every numeric column."""
    from tracework.operators.aggregates import describe_by, long_features

    return describe_by(long_features(df.withColumn("_", F.lit(0)), ["_"], numeric_columns(df)), ["feature"], "value")


def call_method(df: DataFrame, method: str, order: str, n: int = 5) -> DataFrame:
    """One of the allowed methods by name: head, tail, describe, info."""
    allowed = {
        "head": lambda: df.orderBy(order).limit(n),
        "tail": lambda: df.orderBy(F.col(order).desc()).limit(n),
        "describe": lambda: describe_numeric(df),
        "info": lambda: summaries(df.sparkSession, {"data": df}),
    }
    if method not in allowed:
        raise ValueError(f"method {method!r} is not available; use one of {sorted(allowed)}")
    return allowed[method]()
