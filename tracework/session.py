"""Session helpers: a default session, run-time settings and the shared work folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_RANGE = "spark.tracework.rowsPerRange"
DEFAULT_ROWS_PER_RANGE = 1_000_000


def build_session(app: str = "tracework", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with UTC time and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Epoch arithmetic in this library assumes UTC sessions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def rows_per_range(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_RANGE, str(DEFAULT_ROWS_PER_RANGE)))


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a fresh temporary folder
    serves local mode alone, since machines of a cluster do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tracework-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables of the open ``scratch`` block of each thread; plain values, as functions shipped to tasks may take this module along.
_TABLES: dict[int, list[str]] = {}


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back. With ``keep``, the table outlives a ``scratch`` block."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if not keep and (tables := _TABLES.get(get_ident())) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``materialise`` writes inside the block are deleted at its end, so that they take no disk beside later work.

    What leaves the block must rest on tables written with ``keep`` only. A block inside another one leaves its tables to the outer one.
    After an error the tables stay, as running tasks may still read them.
    """
    if get_ident() in _TABLES:
        yield
        return
    _TABLES[get_ident()] = []
    try:
        yield
    finally:
        tables = _TABLES.pop(get_ident())
    spark = SparkSession.active()
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly row work when the input has fewer splits than cores.

    Large inputs have many splits and pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
