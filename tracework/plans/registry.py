"""Registry of runnable queries and the SQL each one is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.functions.numeric import rounded
from tracework.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its check."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip().rstrip(";")
        return fn

    return wrap


class Tables:
    """Lazy access to the given tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def series(self) -> DataFrame:
        """events as sensor rows: part, channel, clock (epoch us), signal."""
        return self.events.select(
            F.col("user_id").alias("part"),
            F.col("event_type").alias("channel"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            "event_id",
            F.col("value").alias("v"),
        )

    @property
    def points(self) -> DataFrame:
        """embeddings exploded: one row per (vec, position)."""
        return self.embeddings.select(
            "vec_id", "label", F.posexplode("embedding").alias("k", "x")
        ).withColumn("x", F.col("x").cast("double"))


def outputs(df: DataFrame, digits: int = 6, nudge: float = 0.0, **overrides: int) -> DataFrame:
    """Round every double column so that two engines print the same number.

    ``nudge`` is added first where short exact decimals would sit on a rounding tie.
    """
    cols: list[Column] = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(
                rounded(F.col(f.name).cast("double") + F.lit(nudge), overrides.get(f.name, digits)).alias(f.name)
            )
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
