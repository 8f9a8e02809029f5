"""Removal of repeated byte passages with longest-previous-factor arrays over bucketed suffixes.

Method. A suffix order of the whole corpus is cut into buckets that can hold equal ``window``-byte prefixes: the segments
of one anchor (see ``repeats``). Inside a bucket the suffixes that start a window are sorted; positions rise inside runs
of equal prefixes, so the previous smaller position in suffix order is the left neighbour of the run and the next one
the right neighbour. The longest previous factor (capped at ``window``) is read off the left neighbour, its mirror image
off the right one. Suffixes whose window hash is alone in the task have no neighbour to match and are left out of the sort.

Buckets above ``BUCKET_BYTES`` (a passage shared by very many texts) are not sorted in one task: their windows are dealt
out by hash, combined before the shuffle, and compared there, which gives the same answer.

Defined results: null texts read as empty; texts shorter than the window keep every byte; rows that repeat an id (or a whole
row) count as further copies; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.repeats import DOC, KEY, Spec, catalogue, intervals, keyed, merged, requests, segments, settled, spans_of, stored, with_texts
from tracework.llm.text import BYTES, Prefix, buffer_of, slices, unpack

WINDOW, GRAM = 200, 32
BUCKET_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
CUT = "anchor long, c1 long, c2 int, n int, n_occ long, _id {id}, _h long, start int, content binary"


def _contents(docs: DataFrame, want: DataFrame, spec: Spec) -> DataFrame:
    """The bytes of the wanted segments."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_n"):
                raw, offsets = buffer_of(unpack(batch.column("_z"), batch.column("_n")))
                data = raw.tobytes()
                rows, cells = [], []
                for i, wanted in enumerate(batch.column("want").to_pylist()):
                    base = int(offsets[i])
                    for w in wanted:
                        at = base + w["start"]
                        rows.append(i)
                        cells.append((w["anchor"], w["c1"], w["c2"], w["n"], w["n_occ"], w["start"], data[at : at + w["n"] + spec.window - 1]))
                if not rows:
                    continue
                take = pa.array(rows)
                a, c1, c2, n, occ, start, content = zip(*cells, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int32()), pa.array(n, pa.int32()), pa.array(occ, pa.int64()),
                     batch.column("_id").take(take), batch.column("_h").take(take), pa.array(start, pa.int32()), pa.array(content, pa.binary())],
                    names=["anchor", "c1", "c2", "n", "n_occ", "_id", "_h", "start", "content"])

    return with_texts(docs, want, "inner").mapInArrow(cut, CUT.format(id=id_type))


def previous_and_next(data: bytes, starts: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes at ``starts``: has the ``window``-byte prefix an earlier, and a later, occurrence among them?

    ``order`` gives the text position rank of each suffix. Sorting by (prefix, position) makes the previous smaller position
    of a run its left neighbour in suffix order: the longest previous factor reaches ``window`` where the two are equal.
    """
    ranked = np.argsort(order, kind="stable")
    at = starts[ranked].tolist()
    prefix = [data[p : p + window] for p in at]
    suffixes = sorted(range(len(at)), key=prefix.__getitem__)
    factor = np.fromiter((prefix[a] == prefix[b] for a, b in zip(suffixes, suffixes[1:], strict=False)), bool, max(len(at) - 1, 0))
    earlier, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    order_of = ranked[np.array(suffixes, np.int64)] if at else ranked
    earlier[order_of[1:]] = factor
    later[order_of[:-1]] = factor
    return earlier, later


def _bucket_chunk(batch: pa.RecordBatch, spec: Spec) -> pa.RecordBatch:
    """Window ranges of each segment of whole buckets: repeated anywhere, and repeated earlier."""
    raw, offsets = buffer_of(batch.column("content"))
    n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    segment = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    offset = np.arange(first[-1]) - first[segment]
    starts = offsets[segment] + offset
    hashes = Prefix(BYTES[0][raw]).ranges(starts, starts + spec.window)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts[inverse] > 1)
    # rows come sorted by first occurrence inside a bucket, and equal windows share a bucket: row order is text order
    earlier, later = previous_and_next(raw.tobytes(), starts[shared], shared, spec.window)
    old, new = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    old[shared], new[shared] = earlier, later
    out = []
    for kind, flags in ((0, old | new), (1, old)):
        lo, hi = intervals(flags, segment)
        s = segment[lo] if len(lo) else lo
        out.append((np.full(len(lo), kind, np.int32), s, offset[lo] if len(lo) else lo, (hi - lo)))
    kind, s, lo, size = (np.concatenate(x) for x in zip(*out, strict=True))
    take = pa.array(s)
    begin = batch.column("start").take(take).to_numpy(zero_copy_only=False) + lo
    return pa.RecordBatch.from_arrays(
        [batch.column("_id").take(take), batch.column("_h").take(take), batch.column("n_occ").take(take), pa.array(kind), pa.array(begin.astype(np.int32)), pa.array((begin + size).astype(np.int32))],
        names=["_id", "_h", "n_occ", "earlier", "lo", "hi"])


def _sorted_buckets(content: DataFrame, spec: Spec) -> DataFrame:
    """Suffix-sort whole buckets: rows of an anchor arrive together, and many small buckets share one sort."""
    id_type = content.schema["_id"].dataType.simpleString()

    def solve(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "content", CHUNK_BYTES):
                held.append(part)
                size += part.column("content").nbytes
                if size < CHUNK_BYTES:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                anchors = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchors, anchors[-1], "left"))  # the last bucket may go on
                if cut:
                    yield _bucket_chunk(table.slice(0, cut).combine_chunks().to_batches()[0], spec)
                held = table.slice(cut).to_batches()
                size = sum(b.column("content").nbytes for b in held) if cut else 0
        if held and sum(len(b) for b in held):
            yield _bucket_chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0], spec)

    return (content.repartition("anchor").sortWithinPartitions("anchor", "_id", "_h", "start")
            .mapInArrow(solve, f"_id {id_type}, _h long, n_occ long, earlier int, lo int, hi int"))


def window_rows(content: DataFrame, spec: Spec) -> DataFrame:
    """One row per window of the given segments: two hashes, the segment's occurrences and the window's place."""
    id_type = content.schema["_id"].dataType.simpleString()

    def deal(batches):
        for whole in batches:
            for batch in slices(whole, "content", 1 << 18):
                raw, offsets = buffer_of(batch.column("content"))
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                segment = np.repeat(np.arange(len(n)), n)
                offset = np.arange(n.sum()) - np.concatenate([[0], np.cumsum(n)])[segment]
                at = offsets[segment] + offset
                take = pa.array(segment)
                start = batch.column("start").take(take).to_numpy(zero_copy_only=False) + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(Prefix(BYTES[f][raw], f).ranges(at, at + spec.window).view(np.int64)) for f in (0, 1)]
                    + [batch.column("n_occ").take(take), batch.column("_id").take(take), batch.column("_h").take(take), pa.array(start.astype(np.int32))],
                    names=["w1", "w2", "n_occ", "_id", "_h", "lo"])

    return content.mapInArrow(deal, f"w1 long, w2 long, n_occ long, _id {id_type}, _h long, lo int")


def _dealt_windows(content: DataFrame, spec: Spec, keep_first: bool) -> DataFrame:
    """The same answer for oversized buckets, by window hash; equal windows are combined before the shuffle."""
    w = window_rows(content, spec)
    place = F.struct("_id", "_h", "lo")
    if keep_first:
        # windows of one text may overlap themselves: the place decides, whichever segment it lies in
        firsts = w.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
        return w.join(firsts, ["w1", "w2"]).where(place != F.col("first")).select("_id", "_h", "n_occ", F.lit(1).alias("earlier"), "lo", (F.col("lo") + 1).alias("hi"))
    often = w.groupBy("w1", "w2").agg(F.sum("n_occ").alias("times")).where("times > 1").select("w1", "w2")
    return w.join(often, ["w1", "w2"], "left_semi").select("_id", "_h", "n_occ", F.lit(0).alias("earlier"), "lo", (F.col("lo") + 1).alias("hi"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """Per row of ``keyed`` docs, sorted window ranges to remove.

    ``keep_first=False`` takes every repeated window; ``keep_first=True`` leaves the first occurrence (smallest id, then
    position) and takes the later ones.
    """
    spec = Spec("byte", window, gram)
    seg = stored(segments(docs, spec), "segments")
    cat = stored(catalogue(seg), "catalogue")
    bytes_in = F.col("units") + F.col("kinds") * (window - 1)
    small, large = cat.where(bytes_in <= BUCKET_BYTES), cat.where(bytes_in > BUCKET_BYTES)
    found = _sorted_buckets(_contents(docs, requests(small), spec), spec).unionByName(_dealt_windows(_contents(docs, requests(large), spec), spec, keep_first))
    wanted = found.where(F.col("earlier") == int(keep_first))
    if keep_first:
        twice = cat.where("n_occ > 1").select(*KEY, F.struct("_id", "_h", "start").alias("first"))
        copies = seg.join(twice, KEY).where(F.struct("_id", "_h", "start") != F.col("first"))
        known = copies.select(*DOC, F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    else:
        known, wanted = settled(seg, cat), wanted.where("n_occ = 1")
    return spans_of(known.unionByName(wanted.select(*DOC, "lo", "hi")))


def suffix_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, keep_first: bool = True) -> DataFrame:
    """Texts without repeated passages: ``id``, ``n_bytes``, ``removed`` (byte spans) and ``kept`` (the remaining bytes).

    ``keep_first`` keeps the first occurrence of a passage and removes later copies; without it every copy goes.
    """
    docs = keyed(df, id_col, text_col)
    id_type = docs.schema["_id"].dataType.simpleString()

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_n"):
                raw, offsets = buffer_of(unpack(batch.column("_z"), batch.column("_n")))
                data, size, removed, kept = raw.tobytes(), [], [], []
                for i, spans in enumerate(batch.column("spans").to_pylist()):
                    text = data[offsets[i] : offsets[i + 1]]
                    gone = merged(spans, window)
                    at, parts = 0, []
                    for lo, hi in gone:
                        parts.append(text[at:lo])
                        at = hi
                    parts.append(text[at:])
                    size.append(len(text))
                    removed.append([{"from": a, "to": b} for a, b in gone])
                    kept.append(b"".join(parts))
                span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(size, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())],
                                                 names=["id", "n_bytes", "removed", "kept"])

    joined = with_texts(docs, repeated_ranges(docs, window, keep_first=keep_first), "left")
    return joined.mapInArrow(cut, f"id {id_type}, n_bytes long, removed array<struct<from:int,to:int>>, kept binary")


def digest(df: DataFrame) -> DataFrame:
    """Every copy removed, as counts and a hash of what is left."""
    out = suffix_dedup(df, keep_first=False)
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["to"] - s["from"]).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


