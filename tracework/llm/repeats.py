"""Windows that repeat anywhere in a corpus: content-anchored segments, their catalogue, and what covers each text.

A window (``window`` consecutive units, bytes or words) is filed under its anchor: the smallest hash among its k-unit
grams (the leftmost, where several are equal). Equal windows have equal anchors, so only windows of one anchor have to be
compared. Consecutive windows with one anchor gram form a segment, the unit that is shuffled: about one row per half window instead of one per position. A segment
whose content occurs twice settles all its windows at once; single segments that share an anchor with others ("open"
ones) are compared window by window, by the caller's method. Nothing is capped: a frequent anchor only means more rows
of the catalogue, and identical segments are combined before the shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.text import BYTES, PIECE, Prefix, buffer_of, canonical, pack, pieces, slices, words
from tracework.session import materialise

KEY = ["anchor", "c1", "c2"]
DOC = ["_id", "_h"]
#: Bytes of text for which a task holds spans, hashes and digests of all words at a time, which take many times the memory.
SCRATCH = PIECE


@dataclass(frozen=True)
class Spec:
    """Window length and anchor gram, in units of ``unit`` ("byte" or "word")."""

    unit: str
    window: int
    gram: int


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows as ``_id``, ``_h`` (hash of the text) and ``_text``: rows that repeat an id stay apart unless they are equal."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cryptographic 128-bit digests of byte ranges, as two 64-bit columns: equal digests mean equal source text."""
    raw = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def runs(grams: np.ndarray, bounds: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, end window and anchor of each maximal run of windows with one anchor."""
    width, low, span = spec.window - spec.gram + 1, grams, 1
    if len(grams) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    whole = np.flatnonzero(np.diff(bounds) >= spec.window)
    first, last = bounds[whole], bounds[whole + 1] - spec.window + 1
    new = np.zeros(len(low) + 1, bool)
    new[1:-1] = low[1:] != low[:-1]
    new[1:] |= grams[: len(low)] == low  # the anchor gram itself is left behind: a further one of equal hash starts its own run
    new[first] = True
    new[last] = True
    marks = np.flatnonzero(new[: len(low)])
    if not len(first) or not len(marks):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    ends = np.append(marks[1:], len(low))
    owner = np.searchsorted(first, marks, "right") - 1
    good = (owner >= 0) & (marks < last[owner])
    return whole[owner[good]], marks[good], ends[good], low[marks[good]]


def segments(docs: DataFrame, spec: Spec) -> DataFrame:
    """One row per segment: its row (``_id``, ``_h``), first window, number of windows, anchor and content hash (96 bits)."""
    id_type = docs.schema["_id"].dataType.simpleString()
    kind = pa.large_binary() if id_type == "binary" else None

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_text", SCRATCH):
                if spec.unit == "word":
                    data, offsets = canonical(batch.column("_text"))
                    begin, finish, values, bounds = words(np.frombuffer(data, np.uint8), offsets)
                else:
                    values, bounds = buffer_of(batch.column("_text"))
                out = []
                for rows, at, start, inner in pieces(bounds, overlap=spec.window - 1):
                    part = values[start : start + int(inner[-1])]
                    one = Prefix(part if spec.unit == "word" else BYTES[0][part])
                    row, low, high, anchor = runs(one.grams(spec.gram), inner, spec)
                    to = high - 1 + spec.window
                    if spec.unit == "word":
                        c1, c2 = digests(data, begin[start + low], finish[start + to - 1]).T
                    else:
                        c1, c2 = one.ranges(low, to), Prefix(BYTES[1][part], 1).ranges(low, to)
                    out.append((rows[row], low - inner[row] + at, high - low, anchor, c1, c2))
                if not out:
                    continue
                row, low, n, anchor, c1, c2 = (np.concatenate(x) for x in zip(*out, strict=True))
                if not len(row):
                    continue
                take = pa.array(row)
                ids = batch.column("_id").take(take)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(kind) if kind else ids, batch.column("_h").take(take), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(anchor.view(np.int64)), pa.array(c1.view(np.int64)), pa.array((c2 >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    names=["_id", "_h", "start", "n", "anchor", "c1", "c2"])

    return docs.mapInArrow(cut, f"_id {id_type}, _h long, start int, n int, anchor long, c1 long, c2 int")


def catalogue(seg: DataFrame) -> DataFrame:
    """Distinct segments of anchors that occur twice or more: occurrences, first occurrence, and the anchor's totals."""
    distinct = seg.groupBy(*KEY).agg(F.count("*").alias("n_occ"), F.min(F.struct("_id", "_h", "start", "n")).alias("rep"))
    totals = distinct.groupBy("anchor").agg(
        F.sum("n_occ").alias("total"), F.count("*").alias("kinds"), F.sum((F.col("n_occ") == 1).cast("long")).alias("open"), F.sum("rep.n").alias("units")
    ).where("total > 1")
    return distinct.join(totals, "anchor").select(*KEY, "n_occ", "rep.*", "kinds", "open", "units")


def requests(cat: DataFrame) -> DataFrame:
    """Per text, the segments whose windows have to be compared: those of anchors with several kinds, one of them open."""
    return cat.where("kinds > 1 and open > 0").groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", *KEY, "n_occ", "units")).alias("want"))


def packed(docs: DataFrame) -> DataFrame:
    """``keyed`` rows with the text packed (``_z``) and its size (``_n``), for shuffles."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                z, n = pack(batch.column("_text"))
                others = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], z, n], names=[*others, "_z", "_n"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    return docs.mapInArrow(run, f"{kept}, _z binary, _n long")


def with_texts(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Join packed texts with one row per text on the null-safe row key."""
    docs = packed(docs)
    right = side.select(F.col("_id").alias("_rid"), F.col("_h").alias("_rh"), *[c for c in side.columns if c not in DOC])
    return docs.join(right, docs["_id"].eqNullSafe(right["_rid"]) & (docs["_h"] == right["_rh"]), how).drop("_rid", "_rh")


def intervals(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index ranges [from, to) of maximal runs of True that stay inside one group."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(flags), bool)
    same[1:] = group[1:] == group[:-1]
    before = np.zeros(len(flags), bool)
    before[1:] = flags[:-1]
    start = np.flatnonzero(flags & ~(same & before))
    after = np.zeros(len(flags), bool)
    after[:-1] = flags[1:] & same[1:]
    return start, np.flatnonzero(flags & ~after) + 1


def settled(seg: DataFrame, cat: DataFrame) -> DataFrame:
    """Occurrences of segments that occur twice or more, as window ranges of their texts."""
    twice = cat.where("n_occ > 1").select(*KEY)
    return seg.join(twice, KEY, "left_semi").select(*DOC, F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))


def spans_of(found: DataFrame) -> DataFrame:
    """Per text, its repeated window ranges, in order."""
    return found.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def merged(spans, window: int) -> list[tuple[int, int]]:
    """Maximal covered unit ranges of sorted window ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for s in spans or ():
        lo, hi = s["lo"], s["hi"] - 1 + window
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    return materialise(df, f"llm-{label}", keep)
