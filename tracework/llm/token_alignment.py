"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

1. Rows are shuffled by their full text; each distinct text stays once, with its number of copies. Equal texts are counted before the
   shuffle, so a text that fills a third of the table costs one row per task.
2. Each distinct text is encoded by both vocabularies. Both token sequences spell the same bytes, so their end offsets cut the bytes
   into stretches, and every stretch is exactly one overlapping pair of tokens (a link). Offsets that both sequences share end a group.
   Texts go into blocks of about ``BLOCK`` bytes; a text's distinct pairs and how often it has each are written with its measures.
3. Pair counts: each block's pairs are summed, weighted by copies, then summed over blocks. One block asks for each of its pairs once,
   so the most frequent pair has one row per block in the join that brings the corpus-wide counts back, and no pair is a hot key.
4. Block by block, the counts are looked up for the links of its texts; the measures are joined to the ids by the SHA-256 of the text.

Nothing is broadcast but the highest count of each token of the second vocabulary, at most as many rows as that file has entries.
Vocabulary files are paths that must exist on every machine.

Defined results: a text that is null or empty, or that one of the vocabularies does not spell back as space + text, has no tokens:
all measures are 0 and the group digest is empty. Special tokens written out in a text are plain text. Equal rows each come back; an
empty table gives an empty table; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import json
import os
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.repeats import stored
from tracework.llm.text import PIECE, slices
from tracework.llm.token_counts import COMMON, UNCOMMON, byte_symbols

#: Bytes of text in a block, and in one call of the tokenizers.
BLOCK, SLICE = 2 * PIECE, PIECE // 2
#: Words a worker remembers; the older half goes when they are more.
CACHE_WORDS = 250_000
#: A text's number and a pair's code share one 64-bit sort key.
CODE_BITS = 40
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Encodes texts with a byte-level vocabulary (A, space + text) and a sentence-piece model (B, which adds the space)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes_a = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.bytes_a[i] = bytes([byte[c] for c in token])
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.width = len(self.bytes_b)
        self.known: dict[str, list[int]] = {}
        # ids followed by each separator: A inside and at the end of its half group, then B likewise
        self.printed = [f"{i}{s}" for n, marks in ((len(self.bytes_a), ",|"), (self.width, ",;")) for s in marks for i in range(n)]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode("utf-8")

    def spelled(self, ids_a: list[int], ids_b: list[int], want: bytes) -> bool:
        return b"".join([self.bytes_a[x] for x in ids_a]) == want and b"".join([self.bytes_b[x] for x in ids_b]) == want

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids of space + text. Its splitter cuts texts into words that are encoded apart, so words met before are looked up; texts of
        uncommon characters are encoded whole."""
        split = [None if UNCOMMON.search(t) else COMMON.findall(" " + t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        known = self.known
        new = list(set().union(*[words for words in split if words]).difference(known))
        if new:
            known.update(zip(new, [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        return [self.a.encode(" " + t, add_special_tokens=False).ids if words is None else list(chain.from_iterable([known[w] for w in words])) for t, words in zip(texts, split, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Which texts both vocabularies spell as space + text, and those texts' ids."""
        filled = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in filled]
        good, out_a, out_b = [], [], []
        for i, a, b in zip(filled, self.encode_a(some), self.b.encode(some, num_threads=1) if some else [], strict=True):
            if self.spelled(a, b, b" " + texts[i].encode("utf-8")):
                good.append(i)
                out_a.append(a)
                out_b.append(b)
        return good, out_a, out_b

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], list[np.ndarray], list[np.ndarray]]:
        """Measures of each text, the digest of its groups, its distinct pair codes and how often it has each."""
        n = len(texts)
        measures = {m: np.zeros(n, np.int64) for m in MEASURES}
        digests, codes, times = [""] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        good, ids_a, ids_b = self.encode(texts)
        if not good:
            return measures, digests, codes, times
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        n_a, n_b = (np.array([len(x) for x in side]) for side in (ids_a, ids_b))
        last = ends_a[np.cumsum(n_a) - 1]  # where each text ends
        ends = np.sort(np.concatenate([ends_a, ends_b]))
        repeated = ends[1:] == ends[:-1]
        cuts, common = ends[np.append(True, ~repeated)], ends[1:][repeated]
        measures["n_a"][good], measures["n_b"][good] = n_a, n_b
        measures["n_groups"][good] = np.diff(np.searchsorted(common, last, "right"), prepend=0)
        measures["n_links"][good] = np.diff(np.searchsorted(cuts, last, "right"), prepend=0)
        # pairs of each text
        code = a[np.searchsorted(ends_a, cuts)] * self.width + b[np.searchsorted(ends_b, cuts)]
        key, count = np.unique(np.searchsorted(last, cuts) << CODE_BITS | code, return_counts=True)
        border = np.searchsorted(key, np.arange(1, len(good)) << CODE_BITS)
        key &= (1 << CODE_BITS) - 1
        # the printed groups: A's tokens of a group, then B's
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        shown = np.concatenate([a + len(self.bytes_a) * (common[group_a] == ends_a), 2 * len(self.bytes_a) + b + self.width * (common[group_b] == ends_b)])
        shown = shown[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        shown = np.split(shown, np.cumsum(n_a + n_b)[:-1])
        for i, s, c, t in zip(good, shown, np.split(key, border), np.split(count, border), strict=True):
            digests[i] = sha256("".join([self.printed[x] for x in s.tolist()])[:-1].encode()).hexdigest()
            codes[i], times[i] = c, t
        return measures, digests, codes, times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _key(text) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def aligned(df: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``key`` (SHA-256), ``copies``, ``block``, the measures, ``groups_sha256``, and its distinct pairs
    (``codes``: A's id times the size of B's vocabulary plus B's id) with their numbers (``times``), as 64-bit and 32-bit integers."""
    distinct = df.select(_text(text_col).alias("_text")).groupBy("_text").agg(F.count("*").alias("copies")).select(_key(F.col("_text")).alias("key"), "copies", "_text")

    def run(batches):
        align = aligner(path_a, path_b).align
        block, filled = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                texts = batch.column("_text").to_pylist()
                if filled >= BLOCK:
                    block, filled = block + 1, 0
                filled += batch.column("_text").nbytes
                measures, digests, codes, times = align(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("copies"), pa.array(np.full(len(texts), block, np.int64)), *[pa.array(measures[m]) for m in MEASURES], pa.array(digests),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([t.astype(np.uint32).tobytes() for t in times], pa.binary())],
                    names=["key", "copies", "block", *MEASURES, "groups_sha256", "codes", "times"])

    return distinct.mapInArrow(run, f"key binary, copies long, block long, {', '.join(f'{m} long' for m in MEASURES)}, groups_sha256 string, codes binary, times binary")


def _arrays(codes: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair codes and numbers of all texts of a batch in a row, and the texts' bounds."""
    cells = codes.to_pylist()
    code, time = np.frombuffer(b"".join(cells), np.int64), np.frombuffer(b"".join(times.to_pylist()), np.uint32).astype(np.int64)
    return code, time, np.concatenate([[0], np.cumsum([len(c) // 8 for c in cells], dtype=np.int64)])


def block_pairs(texts: DataFrame) -> DataFrame:
    """Per block (``block``), its distinct pairs (``code``) and the links of each (``n``), copies counted.

    A block that crosses a batch comes in parts, and a pair of several parts in as many rows.
    """
    def run(batches):
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                code, time, bounds = _arrays(part.column("codes"), part.column("times"))
                if not len(code):
                    continue
                time = time * np.repeat(part.column("copies").to_numpy(), np.diff(bounds))
                order = np.argsort(code, kind="stable")
                code = code[order]
                first = np.flatnonzero(np.diff(code, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), blocks[low])), pa.array(code[first]), pa.array(np.add.reduceat(time[order], first))], names=["block", "code", "n"])

    return texts.select("block", "copies", "codes", "times").mapInArrow(run, "block long, code long, n long")


def pair_totals(texts: DataFrame, width: int) -> DataFrame:
    """Corpus-wide links of each pair (``code``, ``n``), and whether it is the most frequent pair of its B token (``best``, ties too)."""
    totals = stored(block_pairs(texts).groupBy("code").agg(F.sum("n").alias("n")), "pair-totals")
    b = F.pmod("code", F.lit(width))
    highest = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # one row per token of the second vocabulary at most
    return totals.join(F.broadcast(highest), b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(df: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """The alignment table of two vocabularies: ``a``, ``b`` (ids), ``n`` (links in the corpus) and ``best``."""
    width = aligner(path_a, path_b).width
    totals = pair_totals(stored(aligned(df, path_a, path_b, text_col), "aligned"), width)
    return totals.select(F.floor(F.col("code") / width).alias("a"), F.pmod("code", F.lit(width)).alias("b"), "n", "best")


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of one block with ``n_best`` and ``count_sum``, looked up in the block's pairs."""
    code, time, bounds = _arrays(left.column("codes").combine_chunks(), left.column("times").combine_chunks())
    known, n, best = (right.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(known)
    at = order[np.searchsorted(known, code, sorter=order)] if len(code) else np.zeros(0, np.int64)

    def per_text(values: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds]))

    kept = ["key", *MEASURES, "groups_sha256"]
    return pa.Table.from_arrays([*[left.column(c) for c in kept], per_text(time * best[at]), per_text(time * n[at])], names=[*kept, "n_best", "count_sum"])


def token_alignment(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row, with its ``carry`` columns: tokens, groups and links of its text, links whose pair is the best of its B token, and the sum
    of the corpus-wide counts of its links."""
    texts = stored(aligned(df, path_a, path_b, text_col), "aligned")
    totals = stored(pair_totals(texts, aligner(path_a, path_b).width), "pair-counts")
    asked = block_pairs(texts).select("block", "code").join(totals, "code")
    schema = f"key binary, {', '.join(f'{m} long' for m in MEASURES)}, groups_sha256 string, n_best long, count_sum long"
    scored = texts.drop("copies").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_scored, schema)
    rows = df.select(_key(_text(text_col)).alias("key"), F.struct(*[F.col(c) for c in carry]).alias("_carry"))
    # written first: a join of two plain shuffles has the rows of a very frequent text split by adaptive execution
    return rows.join(stored(scored, "scored"), "key").select("_carry.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def digest(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return token_alignment(df, path_a, path_b)
