"""Removal of repeated word passages through a compacted de Bruijn graph of the corpus.

Graph. Edges are windows of ``window`` consecutive words, nodes the ``window - 1`` words two neighbouring windows share.
An edge is repeated if it occurs twice anywhere. Compaction goes in two steps:

1. All windows with one anchor gram (see ``repeats``) follow each other without a branch inside their text; such a stretch is
   shuffled as one row. Where the whole stretch occurs again it is one repeated path at once. Stretches that share their
   anchor with different ones are taken apart into single edges, which are counted by digest.
2. Neighbouring repeated stretches of a text meet in a node. Joins on the stretch find how many different stretches follow
   and precede it; where both numbers are one the node does not branch and the stretches are glued.

Identity is settled on the sources: each row carries its text and word position, and is compared by a 128-bit cryptographic
digest of the words found there, never by a rolling hash alone.

Defined results: null texts have no words; texts shorter than the window keep all words; rows that repeat an id (or a whole row)
count as further copies; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracework.llm.repeats import DOC, KEY, SCRATCH, Spec, catalogue, digests, keyed, merged, requests, segments, stored, with_texts
from tracework.llm.text import canonical, slices, unpack, words
from tracework.session import scratch

WINDOW, GRAM = 35, 8


def edges(docs: DataFrame, want: DataFrame, spec: Spec) -> DataFrame:
    """The single edges of the wanted stretches: digest, occurrences of the stretch and position."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_n", SCRATCH):
                texts = unpack(batch.column("_z"), batch.column("_n"))
                data, offsets = canonical(texts)
                begin, finish, _, bounds = words(np.frombuffer(data, np.uint8), offsets)
                lists = batch.column("want").combine_chunks() if isinstance(batch.column("want"), pa.ChunkedArray) else batch.column("want")
                row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                asked = lists.flatten()
                start, n, occ = (asked.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "n_occ"))
                of = np.repeat(np.arange(len(n)), n)
                at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                word = bounds[row[of]] + at
                found = digests(data, begin[word], finish[word + spec.window - 1]).view(np.int64)
                take = pa.array(row[of])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(take), batch.column("_h").take(take), pa.array(at.astype(np.int32)), pa.array(occ[of]), pa.array(found[:, 0]), pa.array(found[:, 1])],
                    names=["_id", "_h", "lo", "n_occ", "e1", "e2"])

    return with_texts(docs, want, "inner").mapInArrow(cut, f"_id {id_type}, _h long, lo int, n_occ long, e1 long, e2 long")


def repeated_stretches(docs: DataFrame, spec: Spec) -> DataFrame:
    """All repeated stretches of all texts: window range and the identity of the stretch."""
    seg = stored(segments(docs, spec), "segments")
    cat = stored(catalogue(seg), "catalogue")
    whole = seg.join(cat.where("n_occ > 1").select(*KEY), KEY, "left_semi").select(
        *DOC, F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"), F.xxhash64("c1", "c2", "n").alias("stretch"))
    single = edges(docs, requests(cat), spec)
    often = single.groupBy("e1", "e2").agg(F.sum("n_occ").alias("times")).where("times > 1").select("e1", "e2")
    again = single.where("n_occ = 1").join(often, ["e1", "e2"], "left_semi")
    # edges of one text that follow each other: position minus rank is constant inside a run
    run = F.col("lo") - F.row_number().over(Window.partitionBy(*DOC).orderBy("lo"))
    broken = again.withColumn("run", run).groupBy(*DOC, "run").agg(
        F.min("lo").alias("lo"), (F.max("lo") + 1).alias("hi"), F.sum(F.xxhash64("e1", "e2") % (1 << 40)).alias("sum"))
    return whole.unionByName(broken.select(*DOC, "lo", "hi", F.xxhash64("sum", F.col("hi") - F.col("lo")).alias("stretch")))


def compact(stretches: DataFrame) -> DataFrame:
    """Glue neighbouring stretches at nodes that do not branch: one row per path occurrence (``lo``, ``hi``, ``stretches``).

    A node branches if the stretch before it is followed, or the stretch after it preceded, by different stretches anywhere.
    """
    inside = Window.partitionBy(*DOC).orderBy("lo", "hi")
    met = stretches.withColumn("before", F.when(F.lag("hi").over(inside) == F.col("lo"), F.lag("stretch").over(inside)))
    met = stored(met, "stretches", keep=True)
    links = met.where("before is not null").groupBy("before", "stretch").agg(F.count("*").alias("times"))
    ahead = links.groupBy("before").agg(F.count("*").alias("n_after"))
    behind = links.groupBy("stretch").agg(F.count("*").alias("n_before"))
    # a plain path needs one way out of the stretch before and one way into this one
    glue = links.join(ahead, "before").join(behind, "stretch").where("n_after = 1 and n_before = 1").select("before", "stretch", F.lit(True).alias("glued"))
    joined = met.join(glue, ["before", "stretch"], "left")
    path = F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(inside)
    return joined.withColumn("path", path).groupBy(*DOC, "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("stretches"))


def _paths(docs: DataFrame, spec: Spec) -> DataFrame:
    """Repeated paths of ``keyed`` rows. Segments and catalogue, many times the stretches, are deleted once those are written."""
    with scratch():
        return compact(repeated_stretches(docs, spec))


def repeat_paths(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Repeated paths of each text: ``id``, ``first_word``, ``end_word`` and the number of stretches glued into the path."""
    paths = _paths(keyed(df, id_col, text_col), Spec("word", window, gram))
    return paths.select(F.col("_id").alias("id"), F.col("lo").alias("first_word"), (F.col("hi") - 1 + window).alias("end_word"), "stretches")


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts without repeated passages, every copy removed: ``id``, ``n_words``, ``removed`` (word spans), ``kept`` (the
    remaining words joined by one space; untouched texts stay as they are in ``text``), and the ``carry`` columns."""
    docs = keyed(df, id_col, text_col)
    paths = _paths(docs, Spec("word", window, gram))
    spans = paths.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    if carry:
        extra = F.struct(*[F.col(c) for c in carry]).alias("_carry")
        text = F.col(text_col).cast("string")
        docs = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"), extra)

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_n", SCRATCH):
                texts = unpack(batch.column("_z"), batch.column("_n"))
                data, offsets = canonical(texts)
                size, removed, kept = [], [], []
                for i, found in enumerate(batch.column("spans").to_pylist()):
                    tokens = data[offsets[i] : offsets[i + 1]].split()
                    gone = merged(found, window)
                    at, parts = 0, []
                    for lo, hi in gone:
                        parts.extend(tokens[at:lo])
                        at = hi
                    parts.extend(tokens[at:])
                    size.append(len(tokens))
                    removed.append([{"from": a, "to": b} for a, b in gone])
                    kept.append(b" ".join(parts))
                span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
                more = [texts.cast(pa.string()), batch.column("_carry")] if carry else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(size, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string()), *more],
                    names=["id", "n_words", "removed", "kept", *(["text", "_carry"] if carry else [])])

    schema = f"id {docs.schema['_id'].dataType.simpleString()}, n_words long, removed array<struct<from:int,to:int>>, kept string"
    if carry:
        schema += f", text string, _carry {docs.schema['_carry'].dataType.simpleString()}"
    out = with_texts(docs, spans, "left").mapInArrow(cut, schema)
    return out.select("id", "n_words", "removed", "kept", "text", "_carry.*") if carry else out


def digest(df: DataFrame) -> DataFrame:
    out = remove_repeats(df)
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["to"] - s["from"]).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_words", length.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
