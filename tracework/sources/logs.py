"""Text sources: device logs, part catalogs, field dumps, line and profile files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.operators.ordered import ordered_columns
from tracework.operators.quality import with_group_stats

# Column layout of the two device logs and the words in folder names that give the label.
SENSOR_COLUMNS = ("ts_ms", "kind", "x", "y", "z")
REGISTRY_COLUMNS = (
    "time_stamp", "WinPCNCRunning", "CurrentJobProgress", "CurrentJobTimeMin", "CurrentJobTimeSec", "CurrentJobCommandNo",
    "CurrentSpdOvr", "State", "Pos_X", "Pos_Y", "Pos_Z",
)
LABEL_WORDS = {"Worn": 1, "Good": 0}
SIDES = ("frontside", "backside")
FAILED_SENSOR = "SENSOR_FAILURE"


def file_path() -> Column:
    return F.col("_metadata.file_path")


def label_from_path(path: Column) -> Column:
    expr = None
    for word, value in LABEL_WORDS.items():
        hit = path.contains(word)
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def sensor_schema() -> str:
    return ", ".join(f"{c} string" for c in SENSOR_COLUMNS)


def parse_sensor(df: DataFrame, path: Column) -> DataFrame:
    """Rows with a numeric time; preamble, header and trailer lines have none."""
    ts = F.trim("ts_ms").try_cast("double")
    num = lambda c: F.trim(c).try_cast("double").alias(c)
    return df.where(ts.isNotNull()).select(ts.cast("bigint").alias("ts_ms"), num("x"), num("y"), num("z"), label_from_path(path).alias("label"))


def sensor_log(spark: SparkSession, path: str) -> DataFrame:
    """Accelerometer logs of all folders below ``path``; the label comes from the folder name."""
    raw = spark.read.option("encoding", "ISO-8859-1").option("recursiveFileLookup", "true").schema(sensor_schema()).csv(path)
    return parse_sensor(raw, file_path())


def parse_registry(df: DataFrame) -> DataFrame:
    digits = F.substring(F.regexp_replace("time_stamp", r"\.", ""), 1, 13).try_cast("bigint")
    pos = [F.col(c).try_cast("double").alias(c.lower()) for c in ("Pos_X", "Pos_Y", "Pos_Z")]
    return df.select(digits.alias("ts_ms"), *pos).where(F.col("ts_ms").isNotNull())


def registry_log(spark: SparkSession, path: str) -> DataFrame:
    """Position logs: 13 digits of the time stamp and the three positions; other columns are pruned."""
    schema = ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)
    raw = spark.read.option("recursiveFileLookup", "true").schema(schema).csv(path)
    return parse_registry(raw)


def part_catalog(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    schema = "part_id string, process_data array<struct<start_time double, end_time double, anomaly string, data_paths array<string>>>"
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)


def locate_parts(catalog: DataFrame, side: str, entry: int = 1, mark: str = "external", suffix: str = ".h5") -> DataFrame:
    """The one data path per part and side; parts with a failed sensor or without exactly one path get a reason."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")
    p = catalog.select("part_id", F.try_element_at("process_data", F.lit(entry + 1)).alias("p"))
    fits = F.filter("p.data_paths", lambda s: s.contains(side) & s.contains(mark) & s.endswith(suffix))
    failed = F.exists("p.data_paths", lambda s: s.contains(FAILED_SENSOR))
    reason = F.when(F.col("p").isNull(), "no_process").when(failed, "sensor_failure").when(F.size(fits) != 1, "path_count")
    return p.select("part_id", "p.start_time", "p.end_time", F.when(reason.isNull(), fits[0]).alias("path"), reason.alias("reason"))


def check_time_bounds(series: DataFrame, located: DataFrame, key: str, clock: str) -> DataFrame:
    """Per part: do the first and last sample lie inside the process interval?"""
    ends = series.groupBy(key).agg(F.min(clock).alias("first"), F.max(clock).alias("last"))
    return ends.join(located.select(F.col("part_id").alias(key), "start_time", "end_time"), key).withColumn(
        "inside", (F.col("first") >= F.col("start_time")) & (F.col("last") <= F.col("end_time")))


def array_container(spark: SparkSession, path: str, clock: str = "timestamp") -> DataFrame:
    """Sensor matrix stored as Parquet; microseconds become seconds."""
    return spark.read.parquet(path).withColumn(clock, F.col(clock) / 1e6)


def channel_table(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Only the required channels; missing ones are an error before any data is read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing channels: {missing}")
    return df.select(*required)


VECTOR_LINE = r"^\s*\(([-+.eE\d]+)\s+([-+.eE\d]+)\s+([-+.eE\d]+)\)\s*$"
SCALAR_LINE = r"^\s*([-+]?[.\d][-+.eE\d]*)\s*$"


def field_dump(spark: SparkSession, path: str) -> DataFrame:
    """Vector fields stored one folder per time: (t, cell, ux, uy, uz), times shifted to start at 0.

    Files are read by lines, so large ones are split; the cell number follows the line
    order.  A list whose stated count differs from its entries raises an error.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    folder = F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^[^=]*=", "")
    raw = raw.withColumn("t", folder.try_cast("double")).where(F.col("t").isNotNull())
    part = lambda i: F.nullif(F.regexp_extract("value", VECTOR_LINE, i), F.lit("")).cast("double")
    declared = F.max(F.regexp_extract("value", r"^\s*(\d+)\s*$", 1).try_cast("bigint")).alias("_declared")
    counted = F.count(F.when(F.col("value").rlike(VECTOR_LINE), 1)).alias("_counted")
    d = with_group_stats(raw, ["file"], declared, counted).where(F.col("value").rlike(VECTOR_LINE))
    ok = F.when(F.col("_declared") == F.col("_counted"), True).otherwise(F.raise_error(F.concat(F.lit("count mismatch in "), F.col("file"))).cast("boolean"))
    d = d.where(ok).select("file", "t", "_block", "_seq", part(1).alias("ux"), part(2).alias("uy"), part(3).alias("uz"))
    d = ordered_columns(d, ["file"], ["_block", "_seq"], index="cell").drop("file", "_block", "_seq")
    first = d.agg(F.min("t")).scalar()
    return d.withColumn("t", F.col("t") - first)


def line_csv(spark: SparkSession, path: str, component: str, fallback: int = 1) -> DataFrame:
    """Sampled lines: coordinate from the first of x, z, y, coord (else column 0), value by name or position."""
    raw = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path)
    names = raw.columns
    coord = next((c for c in ("x", "z", "y", "coord") if c in names), names[0])
    value = component if component in names else names[min(fallback, len(names) - 1)]
    folder = F.regexp_extract(F.element_at(F.split(file_path(), "/"), -2), r"(\d+(?:\.\d+)?)$", 1)
    token = F.regexp_extract(F.element_at(F.split(file_path(), "/"), -1), r"(\d+(?:\.\d+)?)", 1)
    return raw.select(F.coalesce(folder.try_cast("double"), token.try_cast("double")).alias("t"),
                      F.col(f"`{coord}`").cast("double").alias("coord"), F.col(f"`{value}`").cast("double").alias("value"))


def profile_matrix(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Whitespace-separated numbers with named columns."""
    cells = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(*[cells[i].cast("double").alias(c) for i, c in enumerate(columns)])


SHEAR_LINE = r"^\s*(\S+)\s+\(\s*(\S+)\s+(\S+)\s+(\S+?)\s*\)\s*$"


def shear_table(spark: SparkSession, path: str) -> DataFrame:
    """Wall shear history 'time (x y z)'; lines starting with # are comments."""
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*#") & F.col("value").rlike(SHEAR_LINE))
    names = ("time", "tau_x", "tau_y", "tau_z")
    return raw.select(*[F.regexp_extract("value", SHEAR_LINE, i + 1).cast("double").alias(n) for i, n in enumerate(names)])
