"""BPE encoding by a walk over a trie of distinct words, and decoding.

The words of a batch are put into a trie; a depth-first walk carries, for each prefix, the last token of the prefix's own encoding.
One more symbol extends a prefix: its last token is the longest token that ends there and may stand after the encoding of
the rest. Whether two tokens may stand side by side is settled by splitting both back along their merges. Prefixes that many words
share are therefore encoded once. A word's last symbol carries the end-of-word mark and ends the walk.

Text clean-up and word splitting are the vocabulary file's own (its normaliser and split pattern). The path of the file is a
parameter and must exist on every machine; the file is never copied.

Defined results: a null text is an empty text and has no tokens; special tokens written out in a text become their own ids; rows
that repeat are encoded alike; extra columns are ignored.
"""
from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.text import slices

CACHE_WORDS, CACHE_PAIRS = 120_000, 200_000

# The split pattern whose short form below is used for texts of common Latin letters alone
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: After lower-casing: ASCII (without controls that the two engines could read differently) and Latin-1 letters that are their own normal form.
UNCOMMON = re.compile("[^\t\n\r\x20-\x7eß-öø-ÿ]")
#: Letters outside Latin-1 whose lower case may lie inside it.
CAPITALS = re.compile("[^\x00-ÿ]")
COMMON = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9\t\n\r ]+")


def byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(rest.get(b, b)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and text rules of a word-end BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            self.parts.setdefault(self.ids[a + b], (self.ids[a], self.ids[b]))
            self.rank_of.setdefault(self.ids[a + b], r)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special))) + ")") if self.special else None
        self.tokenizer = Tokenizer.from_file(path)
        self.clean = self.tokenizer.normalizer.normalize_str
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stable: set[int] = set()
        # tokens spelled backwards: those inside a word, and those that end one
        self.inner: dict = {}
        self.final: dict = {}
        for t, i in self.ids.items():
            ends = self.mark and t.endswith(self.mark) and len(t) > len(self.mark)
            node = self.final if ends else self.inner
            for c in reversed(t.removesuffix(self.mark) if ends else t):
                node = node.setdefault(c, {})
            node[None] = i
        self.plain = self.split.pattern == PATTERN

    def fits(self, left: int, right: int) -> bool:
        """May the two tokens stand side by side, that is, does no merge across their border come before those that built them?

        Both are taken apart, the later-built first, while the pieces at the border are checked for a merge.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        limit = 1 << 40  # rank at which the pieces at the border are still apart
        a, b = left, right
        while True:
            found = self.rank.get((a, b))
            if found is not None and found[0] < limit:
                return False
            ra, rb = self.rank_of.get(a, -1), self.rank_of.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # the piece built last is taken apart; of equal merges the left one comes first, also one across the border
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]

    def walk(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words (as symbol strings), shared prefixes once.

        The trie of the words is held as their sorted list: consecutive words share the nodes of their common prefix, so going
        down the list is the depth-first walk, and the states of a shared prefix stay on the stack.
        """
        out: dict[str, tuple[int, ...]] = {}
        last: list[int] = []  # last token of each prefix on the path from the root
        size: list[int] = []  # its length in symbols
        inner, final, pairs, stable = self.inner, self.final, self.pairs, self.stable
        before = ""
        for word in sorted(words):
            end = len(word) - 1
            depth, most = 0, min(len(before), end)
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth:], size[depth:]
            before = word[:-1]
            for depth in range(depth + 1, end + 2):  # noqa: B020
                node, at, found = (final if depth > end else inner), depth, []
                while at:  # tokens that end here, read backwards
                    node = node.get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    if None in node:
                        found.append(at)
                        found.append(node[None])
                while True:
                    if not found:
                        raise ValueError(f"no token for {word!r}")
                    token, at = found.pop(), found.pop()
                    if token not in stable and not self.is_stable(token):
                        continue
                    if not at:
                        break
                    fit = pairs.get((last[at - 1], token))
                    if fit or fit is None and self.fits(last[at - 1], token):
                        break
                if depth <= end:
                    last.append(token)
                    size.append(depth - at)
                else:
                    tokens = [token]
                    while at:
                        tokens.append(last[at - 1])
                        at -= size[at - 1]
                    tokens.reverse()
                    out[word] = tuple(tokens)
        return out

    def is_stable(self, token: int) -> bool:
        """Is the token what its own spelling is encoded as?"""
        good = self._plain(self.names[token]) == (token,)
        if good:
            self.stable.add(token)
        return good

    def _plain(self, spelled: str) -> tuple[int, ...]:
        text = spelled.removesuffix(self.mark) if self.mark and len(spelled) > len(self.mark) and spelled.endswith(self.mark) else spelled
        symbols = list(text)
        if text != spelled:
            symbols[-1] += self.mark
        tokens = [self.ids[s] for s in symbols]
        while len(tokens) > 1:
            r, i = min(((self.rank.get((tokens[i], tokens[i + 1])) or (1 << 40, 0))[0], i) for i in range(len(tokens) - 1))
            if r == 1 << 40:
                break
            tokens[i : i + 2] = [self.rank[tokens[i], tokens[i + 1]][1]]
        return tuple(tokens)

    def spell(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode("utf-8")])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass(frozen=True)
class Special:
    """A special token written out in a text; never equal to a word of the same letters."""

    token: str


class Encoder:
    """Encodes texts batch by batch; words met before are looked up. The cache is emptied at ``CACHE_WORDS``."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.written = {t: Special(t) for t in self.v.special}
        self.known: dict[str | Special, tuple[int, ...]] = {}
        self.printed: dict[str | Special, str] = {}

    def words(self, text: str) -> list[str | Special]:
        """Words of a text in order; special tokens written out in it are of the type ``Special``."""
        v = self.v
        if v.plain and "<|" not in text:
            lower = text.lower()
            if not UNCOMMON.search(lower) and not CAPITALS.search(text):
                return COMMON.findall(lower)
        if v.specials is None or not v.specials.search(text):
            return v.split.findall(v.clean(text))
        out: list[str | Special] = []
        for part in v.specials.split(text):
            if part in v.special:
                out.append(self.written[part])
            elif part:
                out.extend(v.split.findall(v.clean(part)))
        return out

    def learn(self, split: list[list[str | Special]]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.printed.clear()
        new = set().union(*split) - self.known.keys()
        spelled = {self.v.spell(w): w for w in new if type(w) is str}
        for s, ids in self.v.walk(sorted(spelled)).items():
            self.known[spelled[s]] = ids
        for w in new:
            if type(w) is Special:
                self.known[w] = (self.v.special[w.token],)
            self.printed[w] = " ".join(map(str, self.known[w]))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words(t) if t else [] for t in texts]
        self.learn(split)
        return [[i for w in ws for i in self.known[w]] for ws in split]


def encode(df: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``ids`` of each text, with the ``carry`` columns."""
    rows = df.select(F.col(text_col).cast("string").alias("_text"), F.struct(*[F.col(c) for c in carry]).alias("_carry"))

    def run(batches):
        coder = Encoder(path)
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                ids = coder.encode(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("_carry"), pa.array(ids, pa.list_(pa.int32()))], names=["_carry", "ids"])

    out = rows.mapInArrow(run, f"_carry {rows.schema['_carry'].dataType.simpleString()}, ids array<int>")
    return out.select("_carry.*", "ids")


def decode(df: DataFrame, path: str, ids_col: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decoded`` text of each id list, special tokens spelled out, as the vocabulary's own library joins tokens."""
    rows = df.select(F.col(ids_col).alias("_ids"), F.struct(*[F.col(c) for c in carry]).alias("_carry"))

    def run(batches):
        names = vocabulary(path).names
        for batch in batches:
            texts = [None if ids is None else " ".join([names[i] for i in ids if i in names]) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_carry"), pa.array(texts, pa.string())], names=["_carry", "decoded"])

    out = rows.mapInArrow(run, f"_carry {rows.schema['_carry'].dataType.simpleString()}, decoded string")
    return out.select("_carry.*", "decoded")


def digest(df: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of tokens, SHA-256 of the ids (decimal, one space between) and of the decoded text.

    Encoding and decoding are ``encode`` and ``decode`` fused: each distinct word's ids and spelling are printed once and joined.
    """
    from hashlib import sha256

    rows = df.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(c) for c in carry]).alias("_carry"))

    def run(batches):
        coder = Encoder(path)
        spelled: dict[str | Special, str] = {}
        names = coder.v.names
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                split = [coder.words(t) if t else [] for t in batch.column("_text").to_pylist()]
                coder.learn(split)
                if len(spelled) > CACHE_WORDS:
                    spelled.clear()
                known, printed = coder.known, coder.printed
                for w in set().union(*split) - spelled.keys():
                    spelled[w] = " ".join([names[i] for i in known[w]])
                n, ids, texts = [], [], []
                for ws in split:
                    n.append(sum([len(known[w]) for w in ws]))
                    ids.append(sha256(" ".join([printed[w] for w in ws]).encode()).hexdigest())
                    texts.append(sha256(" ".join([spelled[w] for w in ws]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("_carry"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)],
                                                 names=["_carry", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = rows.mapInArrow(run, f"_carry {rows.schema['_carry'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select("_carry.*", "n_tokens", "ids_sha256", "decoded_sha256")
