"""Live tool state as Structured Streaming: tail, gate, window, score, vote.

Offsets live in the stream checkpoint, so a restart continues where it stopped.  Every
operator takes and returns streaming frames; ``run`` writes append results as a table,
``run_latest`` keeps the newest row per key of update-mode results.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracework.operators.windows import LIVE_WINDOW, first_per_key
from tracework.session import fresh_path

LATE = "10 seconds"


def tail(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv", files_per_batch: int = 1, **options) -> DataFrame:
    """New files of a folder as a stream; every row is read once."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def gate(raw: DataFrame, position: DataFrame, key: str, clock: str, depth: str, threshold: float, slack: str = LATE, late: str = LATE) -> DataFrame:
    """Raw rows for which a position row at working depth lies within ``slack``; both sides have watermarks."""
    r = raw.withWatermark(clock, late)
    p = position.where(F.col(depth) >= threshold).select(F.col(key).alias("_k"), F.col(clock).alias("_pt")).withWatermark("_pt", late)
    near = F.expr(f"_k = {key} AND _pt >= {clock} - INTERVAL {slack} AND _pt <= {clock} + INTERVAL {slack}")
    return r.join(p, near, "left_semi")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_on_disk(spark: SparkSession) -> None:
    """Processors with timers keep their state in the store that spills to disk and is checkpointed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval).value // 1000)


class _CountWindows(StatefulProcessor):
    def __init__(self, key: str, clock: str, order: str, axes: list[str], size: int, idle: int | None):
        self.key, self.clock, self.order, self.axes, self.size, self.idle = key, clock, order, axes, size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n bigint")
        self.tail = handle.getListState("tail", ", ".join(f"{a} double" for a in self.axes))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:  # all rows were late
            return
        batch = pd.concat(frames).sort_values(self.order, kind="stable")
        held = [list(r) for r in self.tail.get()] if self.tail.exists() else []
        data = np.concatenate([np.array(held, float).reshape(-1, len(self.axes)), batch[self.axes].to_numpy(float)])
        done = self.done.get()[0] if self.done.exists() else 0
        n = len(data) // self.size
        full, left = data[: n * self.size].reshape(n, self.size, len(self.axes)), data[n * self.size :]
        if len(left):
            self.tail.put([tuple(map(float, r)) for r in left])
        else:
            self.tail.clear()
        self.done.update((done + n,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch[self.clock].max().value // 1_000_000 + self.idle // 1000))
        if n:  # all windows of the batch at once
            out = {self.key: [key[0]] * n, "window_id": np.arange(done, done + n)}
            for i, a in enumerate(self.axes):
                v = full[:, :, i]
                out |= {f"{a}_mean": v.mean(1), f"{a}_std": v.std(1, ddof=1), f"{a}_sum": v.sum(1), f"{a}_median": np.median(v, 1)}
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The machine has been silent: its incomplete window is dropped, as at the end of a recording, and its state goes."""
        self.tail.clear()
        self.done.clear()
        return iter([])

    def close(self) -> None:
        pass


def count_windows(df: DataFrame, key: str, order: str, axes: Sequence[str], size: int = LIVE_WINDOW, clock: str | None = None, idle: str | None = None,
                  late: str = LATE) -> DataFrame:
    """Full windows of ``size`` rows per key carried over micro-batches: four statistics per axis.

    State per key is the incomplete tail, fewer than ``size`` rows, and the number of windows.  With ``idle`` (and ``clock``, a timestamp)
    a key that has been silent for so long loses its state; its windows then count from 0 again.  A call sees one key's rows of one
    micro-batch, which ``files_per_batch`` of ``tail`` bounds.
    """
    _state_on_disk(df.sparkSession)
    stats = ", ".join(f"{a}_{s} double" for a in axes for s in ("mean", "std", "sum", "median"))
    slim = df.select(key, order, *axes, *([clock] if clock and clock != order else []))
    if idle:
        slim = slim.withWatermark(clock, late)
    processor = _CountWindows(key, clock, order, list(axes), size, _micros(idle) if idle else None)
    schema = f"{key} {dict(df.dtypes)[key]}, window_id bigint, {stats}"
    return slim.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime" if idle else "None")


def tumbling(df: DataFrame, clock: str, width: str, keys: Sequence[str], axes: Sequence[str], late: str = LATE) -> DataFrame:
    from tracework.operators.aggregates import time_frames

    return time_frames(df.withWatermark(clock, late), keys, clock, width, axes)


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start bigint, end bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Merge the batch, already counted per clock value, into the open sessions; tell what changed."""
        frames = [f for f in rows if len(f)]
        if not frames:  # all rows were late
            return
        old = sorted(tuple(r) for r in self.open.get()) if self.open.exists() else []
        batch = pd.concat(frames).groupby("at_us")["rows"].sum()
        spans = sorted(old + [(int(t), int(t), int(n)) for t, n in batch.items()])
        merged: list[list[int]] = []
        for start, end, n in spans:
            if merged and start - merged[-1][1] <= self.gap:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], end), merged[-1][2] + n
            else:
                merged.append([start, end, n])
        self.open.put([tuple(m) for m in merged])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((merged[0][1] + self.gap) // 1000 + 1)
        known, now = {(s, n) for s, _, n in old}, {s for s, _, _ in merged}
        changed = [(s, n) for s, _, n in merged if (s, n) not in known] + [(s, 0) for s, _, _ in old if s not in now]
        yield pd.DataFrame({self.key: [key[0]] * len(changed), "start_us": [c[0] for c in changed], "n": [c[1] for c in changed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Sessions that no row can reach any more have been told already; they leave the state."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        left = [tuple(r) for r in self.open.get() if r[1] + self.gap >= passed]
        if left:
            self.open.put(left)
            self.handle.registerTimer((min(r[1] for r in left) + self.gap) // 1000 + 1)
        else:
            self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def sessions(df: DataFrame, clock: str, gap: str, key: str, late: str = LATE) -> DataFrame:
    """Sessions per key, split where the step is longer than ``gap``: key, start_us, n.  For update mode (``run_latest`` by key and start).

    A session is told whenever it changes, so those still open at the end of the data come out too; one that a late row joins to an
    earlier session is told again with n = 0.  State per key is its open sessions; they go once the watermark has passed their gap.
    """
    _state_on_disk(df.sparkSession)
    slim = df.withWatermark(clock, late).select(key, clock, F.unix_micros(clock).alias("at_us"), F.lit(1).cast("long").alias("rows"))
    schema = f"{key} {dict(df.dtypes)[key]}, start_us bigint, n bigint"
    return slim.groupBy(key).transformWithStateInPandas(_Sessions(key, _micros(gap)), schema, "Update", "EventTime")


def vote(df: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """Running counts of both classes and the verdict (same rule as the batch vote)."""
    from tracework.operators.aggregates import vote as batch_vote

    return batch_vote(df, keys, pred)


def threshold_events(df: DataFrame, value: str, high: float, low: float) -> DataFrame:
    """Overshoot and undershoot events with the threshold passed."""
    kind = F.when(F.col(value) > high, "overshoot").when(F.col(value) < low, "undershoot")
    limit = F.when(F.col(value) > high, F.lit(float(high))).otherwise(F.lit(float(low)))
    return df.withColumn("event", kind).where("event IS NOT NULL").withColumn("threshold", limit)


def dedup(df: DataFrame, clock: str, keys: Sequence[str], late: str = LATE) -> DataFrame:
    return df.withWatermark(clock, late).dropDuplicatesWithinWatermark(list(keys))


def score(df: DataFrame, model) -> DataFrame:
    return model.transform(df)


def run(df: DataFrame, label: str) -> DataFrame:
    """Process everything available in append mode into a Parquet table and return it."""
    spark = df.sparkSession
    out = fresh_path(spark, label)
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_latest(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Process everything available in update mode; each batch is one idempotent folder."""
    spark = df.sparkSession
    out = fresh_path(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return first_per_key(spark.read.parquet(out), keys, [F.col("batch").desc()]).drop("batch")
