"""Image and document files, and sinks."""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tracework.operators.ordered import ordered_columns

# File kinds, the upload limit and the log rotation size.
IMAGE_KINDS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
DOCUMENT_KINDS = (".pdf", ".docx", ".txt", ".md")
MAX_TOTAL_BYTES = 200 * 1024 * 1024
LOG_ROWS = 25_000


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and lengths of image files of the six kinds, upper or lower case; content is read only when used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(_kind_of("path"))


def _kind_of(path: str) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(list(IMAGE_KINDS))


def image_table(files: DataFrame, modality: Column, state: Column, label: Column) -> DataFrame:
    """Files with modality, state, label and ids '<modality>_<state>_000000' in path order."""
    d = files.where(_kind_of("path")).select("path", modality.alias("modality"), state.alias("tool_state"), label.alias("label"),
                                             F.element_at(F.split("path", "/"), -1).alias("filename"))
    # paths are ordered as text: their leading bytes as a number give the range column
    prefix = F.conv(F.hex(F.rpad(F.encode("path", "UTF-8"), 6, F.lit(b"\x00"))), 16, 10).cast("double")
    d = ordered_columns(d.withColumn("_p", prefix), ["modality", "tool_state"], ["_p", "path"], index="_i")
    return d.withColumn("sample_id", F.format_string("%s_%s_%06d", "modality", "tool_state", "_i")).drop("_p", "_i")


def document_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Supported documents; other kinds are marked skipped. More bytes in total than a given limit (an upload form has MAX_TOTAL_BYTES) is an error."""
    ok = F.lower("path").rlike("(" + "|".join(k.replace(".", r"\.") for k in DOCUMENT_KINDS) + ")$")
    if limit is not None:
        total = files.agg(F.sum("length")).scalar()
        files = files.where(F.when(total <= limit, True).otherwise(F.raise_error(F.lit("total size exceeds the limit")).cast("boolean")))
    return files.select("path", "length", F.when(ok, "accepted").otherwise("skipped").alias("status"))


# --- pixels: one image per call ---------------------------------------------------------------

def image_header(data: bytes) -> tuple[int, int, str]:
    """Width, height and mode from the header of a PNG, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", data[16:24])
        return w, h, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[data[25]]
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), {8: "P", 24: "RGB", 32: "RGBA"}[struct.unpack("<H", data[28:30])[0]]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2:at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5:at + 9])
                return w, h, {1: "L", 3: "RGB", 4: "CMYK"}[data[at + 9]]
            at += 2 + size
    raise ValueError("cannot identify image")


def pixels(data: bytes) -> np.ndarray:
    """RGB array (h, w, 3) in 0..1 of a 24-bit BMP or an 8-bit PNG."""
    w, h, mode = image_header(data)
    if data[:2] == b"BM" and mode == "RGB":
        start, row = struct.unpack("<I", data[10:14])[0], (w * 3 + 3) // 4 * 4
        body = np.frombuffer(data, np.uint8, row * h, start).reshape(h, row)[:, :w * 3].reshape(h, w, 3)
        flip = struct.unpack("<i", data[22:26])[0] > 0
        return (body[::-1] if flip else body)[:, :, ::-1] / 255.0
    if data[:1] == b"\x89" and mode in ("L", "RGB", "RGBA") and data[24] == 8 and data[28] == 0:
        bands, at, packed = {"L": 1, "RGB": 3, "RGBA": 4}[mode], 8, b""
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at:at + 8])
            packed += data[at + 8:at + 8 + size] if kind == b"IDAT" else b""
            at += 12 + size
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * bands)
        out = np.zeros((h + 1, w + 1, bands), dtype=np.int64)  # border of zeros
        for y in range(h):
            f, cur = lines[y, 0], lines[y, 1:].reshape(w, bands).astype(np.int64)
            up = out[y, 1:]
            if f in (0, 2):
                out[y + 1, 1:] = (cur + (up if f == 2 else 0)) & 255
                continue
            for x in range(w):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                out[y + 1, x + 1] = (cur[x] + {1: a, 3: (a + b) // 2, 4: paeth}[int(f)]) & 255
        body = out[1:, 1:]
        return np.repeat(body, 3, axis=2) / 255.0 if bands == 1 else body[:, :, :3] / 255.0
    raise ValueError(f"unsupported pixel format {mode}")


AUDIT = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("mode", StringType()), StructField("error", StringType())])
STATS = ("gray_mean", "gray_std", "gray_min", "gray_max", "r_mean", "g_mean", "b_mean", "r_std", "g_std", "b_std")


def audit(df: DataFrame, content: str) -> DataFrame:
    """Size and mode of every image, or the error that makes it unreadable."""

    @F.pandas_udf(AUDIT)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for data in s:
            try:
                rows.append((*image_header(bytes(data)), None))
            except Exception as e:  # noqa: BLE001 - the message is the result
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=[f.name for f in AUDIT.fields])

    return df.withColumn("_a", run(F.col(content))).select(*[c for c in df.columns if c != content], "_a.*")


def color_stats(df: DataFrame, content: str) -> DataFrame:
    """Brightness and colour statistics per image."""
    schema = StructType([StructField(n, DoubleType()) for n in STATS])

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for data in s:
            a = pixels(bytes(data))
            g = a @ np.array([0.299, 0.587, 0.114])
            rows.append((g.mean(), g.std(), g.min(), g.max(), *a.mean((0, 1)), *a.std((0, 1))))
        return pd.DataFrame(rows, columns=list(STATS))

    return df.withColumn("_a", run(F.col(content))).select(*[c for c in df.columns if c != content], "_a.*")


def crop_boxes(df: DataFrame, id_col: str, width: str, height: str, seed: int = 42) -> DataFrame:
    """Crop windows per image: full, centred squares of 0.65 and 0.85 of the shorter side, and a seeded square of 0.75."""
    u = lambda salt: F.pmod(F.xxhash64(id_col, F.lit(salt), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    half = F.lit(0.5)
    kinds = [("full", 1.0, half, half), ("center", 0.65, half, half), ("large_center", 0.85, half, half), ("random", 0.75, u("x"), u("y"))]
    boxes = []
    for name, share, ux, uy in kinds:
        side = F.floor(F.least(width, height) * share).cast("int")
        w, h = (F.col(width).cast("int"), F.col(height).cast("int")) if name == "full" else (side, side)
        boxes.append(F.struct(F.lit(name).alias("crop"), F.floor((F.col(width) - w) * ux).cast("int").alias("left"),
                              F.floor((F.col(height) - h) * uy).cast("int").alias("top"), w.alias("w"), h.alias("h")))
    return df.select(*[c for c in df.columns], F.explode(F.array(*boxes)).alias("_b")).select(*df.columns, "_b.*")


# --- sinks ------------------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet or CSV, optionally one folder per state."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    (w.partitionBy(partition_by) if partition_by else w).save(path)


def write_rotating_log(df: DataFrame, path: str, rows: int = LOG_ROWS) -> None:
    """CSV files of at most ``rows`` entries each."""
    df.write.option("maxRecordsPerFile", rows).option("header", "true").csv(path)


def save_model(model, path: str) -> None:
    model.write().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
