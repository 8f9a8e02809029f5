"""Near-duplicate documents by order MinHash, verified by banded alignment.

Texts that are the same sequence of words form one class. Per class, the five-word shingles (labelled by their occurrence number, so
repeats count) are ranked by ``SKETCHES`` hash functions; each sketch takes the ``TAKEN`` smallest and keeps them in text order, so
it is equal only where the texts agree in content and order. Classes are candidates if two sketches agree: with two
shingles per sketch and ten sketches, a pair of similarity 0.8 is missed with probability 7e-4 (0.64 per sketch), one of 0.85 with
7e-5. Candidates of a bucket are linked through a pivot, so no pairs inside a bucket are listed. Pivots come from ``DRAWS`` orders of all
classes, one of which serves a bucket, so the 45 buckets that a family of texts may share agree on at most about as many pivots, and
a member is not compared with one per bucket. Buckets that still hold several groups (template
pages) are settled exactly: of each member at most the rarest fifth of its shingles is kept, rarest among these members first, and members
of different groups that share one of them are compared. Two texts of similarity 0.8 always share one, so no pair of a bucket is lost.
Most of these pairs would only tell again that a text belongs to a large group. So each member first meets, per kept shingle, the ``ASKED``
least altered texts, those with the fewest rarer shingles; where any text of a group is like it, they mostly are. What is listed in
full afterwards are the pairs of texts that are still in different groups.

A candidate is a link if the in-order common shingles of the two word sequences, found by an edit alignment inside the band that the
threshold allows, reach a Jaccard similarity of ``SIMILARITY``. Groups are the connected components of links.

Defined results: texts without words form one class; texts of fewer than five words have one shingle, the whole text; the smallest id
of a group is kept (null ids last); rows that repeat both id and words are one document and come back once; extra columns are ignored.
"""
from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracework.llm.graph import components
from tracework.llm.repeats import keyed, stored, with_texts
from tracework.llm.text import Prefix, canonical, mix, seeded, slices, unpack, words
from tracework.session import scratch

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 10, 2
#: Orders in which pivots are drawn: more link more members at once, fewer compare each with fewer pivots.
DRAWS = 4
#: Texts that all others with a shingle in common meet before pairs are listed.
ASKED = 4
#: Cells of an alignment's band for which matching runs are tabulated.
BAND = 1 << 21
ODD = seeded(SKETCHES, 101) | np.uint64(1)
LAST = np.uint64((1 << 64) - 1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row in text order, and the shingle bounds of the rows."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = bounds[row] + np.arange(out[-1]) - out[row]
    return Prefix(hashes).ranges(start, np.minimum(start + k, bounds[row + 1])), out


def labelled(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number inside the row mixed in."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((grams, row))
    same = np.zeros(len(order), bool)
    same[1:] = (grams[order][1:] == grams[order][:-1]) & (row[order][1:] == row[order][:-1])
    at = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    number = np.empty(len(order), np.uint64)
    number[order] = (at - begin).astype(np.uint64)
    return mix(grams + number * np.uint64(0x9E3779B97F4A7C15))


def sketches(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x ``SKETCHES``: each the smallest labelled shingles of one ranking, in text order. Rows must have a shingle."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros((len(bounds) - 1, SKETCHES), np.uint64)
    for s in range(SKETCHES):
        rank = grams * ODD[s]
        rank ^= rank >> np.uint64(29)
        chosen = np.zeros(len(grams), bool)
        for _ in range(TAKEN):
            low = np.minimum.reduceat(rank, bounds[:-1])
            hit = np.flatnonzero((rank == low[row]) & (rank != LAST))
            chosen[hit] = True
            rank[hit] = LAST
        at = np.flatnonzero(chosen)
        value = np.zeros(len(out), np.uint64)
        place = np.arange(len(at)) - np.searchsorted(row[at], row[at], "left")
        for p in range(TAKEN):
            here = place == p
            value[row[at[here]]] = mix(value[row[at[here]]] * np.uint64(31) + grams[at[here]] + np.uint64(p + 1))
        out[:, s] = value
    return out


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``keyed`` docs: the class digest ``k``, and the bucket keys of its sketches (null without words)."""
    id_type = docs.schema["_id"].dataType.simpleString()
    one, two = np.triu_indices(SKETCHES, 1)

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                data, offsets = canonical(batch.column("_text"))
                _, _, hashes, bounds = words(np.frombuffer(data, np.uint8), offsets)
                digest = [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                filled = np.flatnonzero(np.diff(bounds))
                keys: list[np.ndarray | None] = [None] * len(batch)
                if len(filled):
                    inner = np.append(bounds[filled], bounds[-1])
                    grams, cuts = shingles(hashes, inner)
                    found = sketches(labelled(grams, cuts), cuts)
                    both = mix(found[:, one] * np.uint64(3) + found[:, two] + (one * SKETCHES + two).astype(np.uint64)).view(np.int64)
                    for i, r in enumerate(filled):
                        keys[r] = both[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_h"), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_h", "k", "keys"])

    return docs.mapInArrow(cut, f"_id {id_type}, _h long, k binary, keys array<long>")


def runs_on_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Cells [k + most + 1, x]: how many words agree from place x of ``a`` and place x - k of ``b`` on; diagonals -most-1 to most+1."""
    n, m = len(a), len(b)
    y = np.arange(n + 1) - np.arange(-most - 1, most + 2)[:, None]
    inside = (y >= 0) & (y < m)
    inside[:, n] = False
    agree = inside & (np.append(a, a[-1:])[None, :] == b[np.where(inside, y, 0)])
    stop = np.where(agree, n + 1, np.arange(n + 1)).astype(np.int32)
    return np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1] - np.arange(n + 1, dtype=np.int32)


def alignment(a: np.ndarray, b: np.ndarray, most: int) -> list[int] | None:
    """Lengths of the matching runs of a shortest edit script (insertions and deletions), or None above ``most`` edits.

    Greedy furthest-reaching alignment: only the diagonals within ``most`` of the main one, the band, are ever visited. All diagonals
    advance together; in a band of up to ``BAND`` cells the matching runs are worked out beforehand, in a wider one where they are met.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    off = most + 1
    table = runs_on_diagonals(a, b, most) if n and m and (2 * most + 3) * (n + 1) <= BAND else None

    def slide(x: int, y: int) -> int:
        begin, step = x, 16
        while x < n and y < m:
            size = min(step, n - x, m - y)
            differ = np.flatnonzero(a[x : x + size] != b[y : y + size])
            if len(differ):
                return x + int(differ[0]) - begin
            x, y, step = x + size, y + size, min(step * 4, 1 << 16)
        return x - begin

    reach = np.full(2 * most + 3, -1, np.int64)
    reach[off + 1] = 0
    trail: list[np.ndarray] = []
    for d in range(most + 1):
        trail.append(reach[off - d - 1 : off + d + 2].astype(np.int32))
        k = np.arange(-d, d + 1, 2)
        up, right = reach[k + 1 + off], reach[k - 1 + off]
        take = right < up
        take[0] = True
        if d:
            take[-1] = False
        x = np.where(take, up, right + 1)
        y = x - k
        good = np.flatnonzero((x <= n) & (y <= m) & (y >= 0))
        if table is not None:
            x[good] += table[k[good] + off, x[good]]
        else:
            x[good] += np.array([slide(i, j) for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True)], np.int64)
        reach[k + off] = x
        # the end lies on one diagonal
        if (n - m - d) % 2 == 0 and abs(n - m) <= d and reach[n - m + off] == n:
            lengths, x, y = [], n, m
            for e in range(d, -1, -1):
                v, k, mid = trail[e], x - y, e + 1
                before = k + 1 if k == -e or (k != e and v[mid + k - 1] < v[mid + k + 1]) else k - 1
                px = int(v[mid + before]) if e else 0
                start = (px if before == k + 1 else px + 1) if e else 0
                lengths.append(x - start)
                x, y = px, px - before
            return lengths
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Do the in-order common shingles of two word sequences reach the Jaccard similarity ``least``?"""
    na, nb = max(1, len(a) - SHINGLE + 1), max(1, len(b) - SHINGLE + 1)
    if len(a) < SHINGLE or len(b) < SHINGLE:
        return len(a) == len(b) and bool((a == b).all())
    need = least / (1 + least) * (na + nb)
    if min(na, nb) < need - 1e-9:
        return False
    ga, gb = (Prefix(x.astype(np.uint64)).grams(SHINGLE) for x in (a, b))
    both, which = np.unique(np.concatenate([ga, gb]), return_inverse=True)
    common = np.minimum(np.bincount(which[:na], minlength=len(both)), np.bincount(which[na:], minlength=len(both))).sum()
    if common < need - 1e-9:
        return False  # even out of order the shingles do not suffice
    runs = alignment(a, b, int(na + nb - 2 * need + 1e-9))
    return runs is not None and sum(max(0, r - SHINGLE + 1) for r in runs) >= need - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (``a``, ``b``) with ``ok``: whether the texts are similar."""
    def check(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("wa", "wb"))
            ok = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    with_both = pairs.join(texts.toDF("a", "wa"), "a").join(texts.toDF("b", "wb"), "b").select("a", "b", "wa", "wb")
    return with_both.mapInArrow(check, "a binary, b binary, ok boolean")


def _word_ids(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The word sequences (32-bit word hashes) of the given classes, read from their representatives."""
    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "_n", 1 << 20):
                data, offsets = canonical(unpack(batch.column("_z"), batch.column("_n")))
                _, _, hashes, bounds = words(np.frombuffer(data, np.uint8), offsets)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), pa.array([short[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["k", "ids"])

    return with_texts(docs, nodes, "inner").mapInArrow(cut, "k binary, ids binary")


def _pivots(members: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of each bucket with its pivot, and the bucket rows with their pivot: the first in the bucket's order."""
    draw = F.xxhash64("k", F.pmod("key", F.lit(DRAWS)), F.lit(salt))
    first = members.groupBy("key").agg(F.min(F.struct(draw.alias("r"), "k"))["k"].alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    # written first: only a join of two plain shuffles has its crowded keys split by adaptive execution
    rows = members.join(stored(first, "pivots"), "key").where("k <> pivot")
    return rows.select(F.least("k", "pivot").alias("a"), F.greatest("k", "pivot").alias("b")).distinct(), rows


def _tokens(texts: DataFrame) -> DataFrame:
    """Labelled shingles ``t`` of word sequences (``k``, ``root``, ``ids``), with their number ``n``; texts below one shingle are left out."""
    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "ids", 1 << 20):
                found = [np.frombuffer(x, np.uint32) for x in batch.column("ids").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                grams, cuts = shingles(np.concatenate(found).astype(np.uint64), bounds)
                tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(labelled(grams, cuts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("root"), tokens], names=["k", "root", "t"])

    # shorter texts are alike only if they are equal, and equal texts are one class
    long = texts.where(F.length("ids") >= 4 * SHINGLE)
    return long.mapInArrow(cut, "k binary, root binary, t array<long>").select("k", "root", F.size("t").alias("n"), F.explode("t").alias("t"))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the group (``root``) of their text ``k``."""
    groups = components(links).withColumnRenamed("node", "k")
    return rows.join(groups, "k", "left").withColumn("root", F.coalesce("root", "k"))


def _prefixes(bucket: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the members of buckets that hold several groups beside their pivot, the rarest shingles (``t``, ``k``, ``n``, ``place``): the prefixes of an exact filter.

    If the common shingles of two texts reach the similarity, then in one order of all shingles the first common one stands near
    the front of both; with the rare ones first, what a template gives to all its pages stands behind that place unless they are alike.
    """
    rows = stored(_rooted(bucket.select("k", "key"), links), "grouped")
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = rows.join(stored(several, "several"), "key").select("k", "root").distinct()
    tokens = stored(_tokens(members.join(texts, "k").select("k", "root", "ids")), "tokens")
    counts = stored(tokens.groupBy("t").agg(F.count("*").alias("texts"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("short")), "token-counts")
    place = F.row_number().over(Window.partitionBy("k").orderBy("texts", "t"))
    # at the first shingle that a similar pair shares, what is left of either text, this shingle included, still suffices
    share = SIMILARITY / (1 + SIMILARITY)
    partner = F.greatest(F.col("short"), F.col("n") * SIMILARITY)
    ranked = tokens.join(counts, "t").withColumn("place", place).where(F.col("n") - F.col("place") + 1 >= (F.col("n") + partner) * share - 1e-6)
    # shingles of one group only link nothing new
    return stored(ranked.where("lo <> hi").select("t", "k", "root", "n", F.col("place").cast("int").alias("place")), "prefixes")


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of texts of different groups that share a shingle and may reach the similarity, by their lengths and the shingle's places."""
    left, right = (x.select("t", *[F.col(c).alias(f"{c}{y}") for c in ("k", "root", "n", "place")]) for x, y in ((left, "a"), (right, "b")))
    share = SIMILARITY / (1 + SIMILARITY)
    enough = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb")) + 1 >= (F.col("na") + F.col("nb")) * share - 1e-6
    near = F.least("na", "nb") >= F.greatest("na", "nb") * SIMILARITY - 1e-6
    return left.join(right, "t").where((F.col("roota") != F.col("rootb")) & near & enough)


def _asked(prefix: DataFrame) -> DataFrame:
    """Pairs of each text with the least altered texts that share one of its rarest shingles: at most ``ASKED`` per row of the prefixes."""
    turn = F.row_number().over(Window.partitionBy("t").orderBy("place", "n", "k"))
    first = stored(prefix.withColumn("turn", turn).where(F.col("turn") <= ASKED).drop("turn"), "asked")
    return _meeting(prefix, first).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def _remaining(prefix: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of different groups whose prefixes meet."""
    rows = stored(_rooted(prefix.drop("root"), links), "grouped")
    several = rows.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t")
    rows = stored(rows.join(several, "t"), "prefixes")
    return _meeting(rows, rows).where("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct()


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id``, ``_h`` (text hash), ``class_id`` (smallest id of the same words), ``group_id`` (smallest id of
    the group of near duplicates) and ``kept``."""
    with scratch():
        return _grouped(keyed(df, id_col, text_col))


def _grouped(docs: DataFrame) -> DataFrame:
    rows = stored(classes(docs), "classes")
    place = F.struct(F.col("_id").isNull().alias("n"), "_id", "_h")
    reps = rows.groupBy("k").agg(F.min(place).alias("first"), F.first("keys").alias("keys"))
    reps = stored(reps, "representatives")
    members = stored(reps.where("keys is not null").select("k", F.explode(F.array_distinct("keys")).alias("key")), "buckets")
    pairs, bucket = _pivots(members, 0)
    pairs = stored(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    texts = stored(_word_ids(docs, reps.join(nodes, "k").select("k", "first._id", "first._h")), "words")
    checked = stored(_verified(pairs, texts), "checked")
    prefix = _prefixes(bucket, checked.where("ok").select("a", "b"), texts)
    for meet in (_asked, lambda prefix: _remaining(prefix, checked.where("ok").select("a", "b"))):
        pairs = stored(meet(prefix).join(checked, ["a", "b"], "left_anti"), "candidates")
        checked = checked.union(stored(_verified(pairs, texts), "checked"))
    groups = components(checked.where("ok").select("a", "b"))
    named = reps.select("k", "first").join(groups.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = stored(named, "named")
    best = stored(named.groupBy("root").agg(F.min("first").alias("best")), "best")
    known = stored(named.join(best, "root").select("k", "first", "best"), "known")
    whole = rows.select("_id", "_h", "k").distinct().join(known, "k")
    whole = whole.select(F.col("_id").alias("id"), "_h", F.col("first._id").alias("class_id"), F.col("best._id").alias("group_id"), (place == F.col("best")).alias("kept"))
    return stored(whole, "groups", keep=True)


def digest(df: DataFrame) -> DataFrame:
    return near_duplicates(df).select(F.col("id").alias("doc_id"), "class_id", "group_id", "kept")
