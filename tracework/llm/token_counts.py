"""Token counts of a byte-level BPE vocabulary: merges counted with a heap over a linked list, without emitting identifiers.

A word starts as one symbol per UTF-8 byte in a doubly linked list. A heap holds the adjacent pairs that may merge, keyed by rank and then
place; the lowest is popped, and if that pair still stands there its right symbol is unlinked and the two new neighbour pairs are pushed.
Every merge removes one symbol, so a word has as many tokens as it has bytes less its merges; no list of ids is built.
A word of n bytes costs O(n log n), however long it is. Words met before are looked up; the table of a worker is bounded by
``CACHE_WORDS`` and drops its older half when full, which changes no count.

Text is cut into words as the vocabulary's byte-level splitter does it: texts of ASCII and common Latin letters by the short form of its
pattern, all others by the library's own splitter. Special tokens written out in a text count as one token each.

The vocabulary file is a path that must exist on every machine. No row is shuffled: each text is counted where it is read.

Defined results: a null text is an empty text with 0 bytes and 0 tokens; equal rows are counted alike and each comes back; an empty
table gives an empty table; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.text import PIECE, slices

#: Words a worker remembers, and the longest it remembers (longer ones are counted each time).
CACHE_WORDS, CACHE_LENGTH = 400_000, 64
#: Tokens that fit a training window.
LIMIT = 512

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
UNCOMMON = re.compile(f"[^\t\n\r\x20-\x7e{_LETTERS}]")
#: The split pattern of byte-level vocabularies over the characters that ``UNCOMMON`` leaves.
COMMON = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_BITS = 32


def byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Counter:
    """Counts tokens of texts for one byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.first = [ids[s] for s in byte_symbols()]
        self.width = max(ids.values()) + 1
        self.rank = {ids[a] * self.width + ids[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = frozenset(special)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int] = {}

    def merges(self, word: bytes) -> int:
        """Number of merges that the symbols of one word undergo."""
        rank, merged, width = self.rank.get, self.merged, self.width
        symbol = [self.first[b] for b in word]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            r = rank(symbol[at] * width + symbol[at + 1])
            if r is not None:
                heap.append(r << _BITS | at)
        heapify(heap)
        done, place = 0, (1 << _BITS) - 1
        while heap:
            top = heappop(heap)
            r, at = top >> _BITS, top & place
            if symbol[at] < 0:
                continue  # the left symbol has been merged away
            right = after[at]
            if right == n or rank(symbol[at] * width + symbol[right]) != r:
                continue  # another pair stands here now
            symbol[at], symbol[right] = merged[r], -1
            following = after[right]
            after[at] = following
            done += 1
            if following < n:
                before[following] = at
                r = rank(symbol[at] * width + symbol[following])
                if r is not None:
                    heappush(heap, r << _BITS | at)
            left = before[at]
            if left >= 0:
                r = rank(symbol[left] * width + symbol[at])
                if r is not None:
                    heappush(heap, r << _BITS | left)
        return done

    def tokens(self, word: str) -> int:
        raw = word.encode("utf-8")
        return len(raw) - self.merges(raw)

    def words(self, text: str) -> list[str]:
        """The words of a stretch of text that holds no special token."""
        if UNCOMMON.search(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return COMMON.findall(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is not None and self.specials.search(text):
            return sum(1 if part in self.special else self._plain(part) for part in self.specials.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        words, known = self.words(text), self.known
        new = set(words).difference(known)
        long: dict[str, int] = {}
        for w in new:
            (known if len(w) <= CACHE_LENGTH else long)[w] = self.tokens(w)
        if long:
            return sum([known[w] if w in known else long[w] for w in words])
        total = sum(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            self.known = dict(islice(known.items(), len(known) // 2, None))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker process and file, so words learned in one task serve the next."""
    return Counter(path)


def token_counts(df: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_bytes`` (UTF-8) and ``n_tokens`` of each text, with the ``carry`` columns."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"), text.alias("_text"))

    def run(batches):
        count = counter(path).count
        for whole in batches:
            for batch in slices(whole, "_text", PIECE):
                n = pa.array([count(t) for t in batch.column("_text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_carry"), batch.column("_bytes"), n], names=["_carry", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"_carry {rows.schema['_carry'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select("_carry.*", "n_bytes", "n_tokens")


def digest(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return token_counts(df, path).withColumn("over_limit", F.col("n_tokens") > limit)
