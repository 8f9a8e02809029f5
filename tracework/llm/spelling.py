"""Spelling variants: words one inserted, deleted or replaced code point apart, by integer pairs of trie nodes.

The prefixes of all words are the nodes of a trie, their suffixes those of the trie of the reversed words, and every node has a number.
A word cut at a place is an integer pair (prefix node, suffix node) that stands for the whole word; a word with one place skipped is the
pair (node before the place, node behind it). Two words that skip into the same pair differ by a replacement, and a word that skips into
the pair of another one holds one code point more. Pairs are compared as integers, and equal pairs mean equal spelling, so what
meets is exact and nothing has to be verified.

Numbers: a node at a depth of up to ``DIRECT`` is the number that its path spells in base 91 (the alphabet has 90 code points), so the
shallow nodes, which very many words share, need no table. Deeper nodes are told apart by a 128-bit digest of their path, numbered once in
a written table.

Under one pair meet at most 90 skipping words (one per code point of the alphabet) and one whole word, so groups are bounded whatever
the vocabulary. A place inside a run of one letter is skipped for deletion only at its first letter, so each neighbour counts once.

Words: maximal runs of letters of the alphabet, with A-Z in lower case; each document may misspell a run, by a fixed rule of its id (see
``occurrences``). Runs are counted in the task that reads the text and again after a shuffle by word; no occurrence is shuffled on its own.

Defined results: null texts have no words, a null id reads as an empty one, equal rows count each, an empty table gives an empty table;
extra columns are ignored, whatever their names. Of equally frequent near words the first in code-point order is the form.
"""
from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracework.llm.repeats import stored
from tracework.llm.text import PIECE, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]
#: Digit of each code point in a node's number.
DIGIT = {c: i + 1 for i, c in enumerate(LETTERS)}
BASE, DIRECT = len(LETTERS) + 1, 9
DEEP = 1 << 62
#: One run in so many (by its document and spelling) loses a code point.
SLIP = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Distinct words a task counts before it hands its counts on.
HELD = 200_000


def misspelled(doc_id: str, word: str) -> str:
    """The word as the document spells it: if ``SLIP`` divides the checksum of id and word, one code point is left out."""
    h = crc32(f"{doc_id}:{word}".encode())
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def occurrences(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``word`` and its number of occurrences ``n``, all lengths and counts."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "_text", PIECE):
                for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                    if not text:
                        continue
                    # bytes.lower touches A-Z only
                    runs = Counter(RUN.findall(text.encode().lower().decode()))
                    head = crc32(f"{doc_id}:".encode())
                    for word, n in runs.items():
                        if crc32(word.encode(), head) % SLIP:
                            counts[word] += n
                        else:
                            counts[misspelled(doc_id, word)] += n
                if len(counts) >= HELD:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return rows.mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """The counted words that are long and frequent enough, with an integer ``wid`` that rises in code-point order."""
    chosen = counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    return stored(chosen.orderBy("word").select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "vocabulary")


def _paths(word: str) -> tuple[list[int], list[bytes]]:
    """Numbers of the word's prefixes of up to ``DIRECT`` code points (the empty one first), and digests of the longer ones."""
    numbers, value = [0], 0
    for c in word[:DIRECT]:
        value = value * BASE + DIGIT[c]
        numbers.append(value)
    if len(word) <= DIRECT:
        return numbers, []
    state = blake2b(word[:DIRECT].encode(), digest_size=16)
    deep = []
    for c in word[DIRECT:]:
        state.update(c.encode())
        deep.append(state.copy().digest())
    return numbers, deep


def _nodes(words: DataFrame) -> DataFrame:
    """Per word, side (forward: prefixes) and place of the cut: the node there, as its ``number``, or its ``digest`` where it is deep.

    ``again`` marks the places whose letter before the cut equals the one before that.
    """
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "word", 1 << 16):
                wid, n, forward, cut, again, number, digest = [], [], [], [], [], [], []
                for w, count, word in zip(batch.column("wid").to_pylist(), batch.column("n").to_pylist(), batch.column("word").to_pylist(), strict=True):
                    size = len(word) + 1
                    repeats = [i > 1 and word[i - 1] == word[i - 2] for i in range(size)]
                    for side, path in ((True, word), (False, word[::-1])):
                        shallow, deep = _paths(path)
                        wid += [w] * size
                        n += [count] * size
                        forward += [side] * size
                        cut += range(size) if side else range(size - 1, -1, -1)
                        again += repeats if side else repeats[::-1]
                        number += shallow + [None] * len(deep)
                        digest += [None] * len(shallow) + deep
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wid, pa.int64()), pa.array(n, pa.int64()), pa.array(forward, pa.bool_()), pa.array(cut, pa.int32()), pa.array(again, pa.bool_()),
                     pa.array(number, pa.int64()), pa.array(digest, pa.binary())], names=["wid", "n", "forward", "cut", "again", "number", "digest"])

    return words.select("wid", "n", "word").mapInArrow(run, "wid long, n long, forward boolean, cut int, again boolean, number long, digest binary")


def trie_nodes(words: DataFrame) -> DataFrame:
    """``wid``, ``n``, ``forward``, ``cut``, ``again`` and ``node``: the numbered nodes on each word's paths through the two tries."""
    nodes = stored(_nodes(words), "paths")
    deep = nodes.where("digest is not null").drop("number")
    table = stored(deep.select("forward", "digest").distinct().withColumn("node", F.lit(DEEP) + F.monotonically_increasing_id()), "trie")
    return nodes.where("digest is null").drop("digest").withColumnRenamed("number", "node").unionByName(deep.join(table, ["forward", "digest"]).drop("digest"))


WHOLE, SKIPPED, SKIPPED_AGAIN = 0, 1, 2


def node_pairs(words: DataFrame) -> DataFrame:
    """The pair dictionary: ``prefix`` and ``suffix`` (nodes), ``wid``, ``n`` and ``kind``: the whole word cut at a place, the word with a
    place skipped, or the latter where the letter before the place is the skipped one too."""
    nodes = trie_nodes(words)
    ahead = nodes.where("forward").select("wid", "cut", "n", F.col("node").alias("prefix"))
    skip = F.when(F.col("cut") > 0, F.struct((F.col("cut") - 1).alias("cut"), F.when(F.col("again"), SKIPPED_AGAIN).otherwise(SKIPPED).alias("kind")))
    both = F.explode(F.array(F.struct("cut", F.lit(WHOLE).alias("kind")), skip))
    back = nodes.where("not forward").select("wid", F.col("node").alias("suffix"), both.alias("at")).where("at is not null").select("wid", "suffix", "at.*")
    return ahead.join(back, ["wid", "cut"]).select("prefix", "suffix", "wid", "n", "kind")


def neighbours(words: DataFrame) -> DataFrame:
    """All pairs of near words (``wid``, ``near``), each in both directions. A word has at most 90 replacements a place and 90 insertions a
    cut, so the result grows with the vocabulary."""
    pairs = stored(node_pairs(words), "node-pairs")
    skipped = pairs.where(F.col("kind") != WHOLE).select("prefix", "suffix", "wid")
    replaced = skipped.join(skipped.withColumnRenamed("wid", "near"), ["prefix", "suffix"]).where("wid <> near").select("wid", "near")
    longer = pairs.where(F.col("kind") == SKIPPED).select("prefix", "suffix", "wid")
    shorter = pairs.where(F.col("kind") == WHOLE).select("prefix", "suffix", F.col("wid").alias("near"))
    deleted = longer.join(shorter, ["prefix", "suffix"]).select("wid", "near")
    return replaced.union(deleted).union(deleted.select(F.col("near").alias("wid"), F.col("wid").alias("near")))


def best_neighbours(words: DataFrame) -> DataFrame:
    """Of each word with near words: their number ``n_near``, and the most frequent one (``best``: its ``n`` negated and its ``wid``) unless
    the word itself is at least as frequent as all of those.

    The words that meet in a pair are counted and compared there, at most 91 rows; pairs of words are not listed.
    """
    pairs = node_pairs(words)
    meet = Window.partitionBy("prefix", "suffix")
    me, kind = F.struct((-F.col("n")).alias("minus_n"), F.col("wid").alias("wid")), F.col("kind")
    counted = pairs.select(
        "wid", "kind", F.count(F.when(kind != WHOLE, 1)).over(meet).alias("skips"), F.count(F.when(kind == SKIPPED, 1)).over(meet).alias("longer"),
        F.min(F.when(kind == WHOLE, me)).over(meet).alias("whole"), F.min(F.when(kind != WHOLE, me)).over(meet).alias("skip"), F.min(F.when(kind == SKIPPED, me)).over(meet).alias("long"))
    near = F.when(kind == WHOLE, F.col("longer")).otherwise(F.col("skips") - 1) + F.when((kind == SKIPPED) & F.col("whole").isNotNull(), 1).otherwise(0)
    other = F.when(F.col("skip.wid") != F.col("wid"), F.col("skip"))  # where the word itself leads, no other one has more occurrences
    best = F.when(kind == WHOLE, F.col("long")).when(kind == SKIPPED, F.least(other, F.col("whole"))).otherwise(other)
    return counted.select("wid", near.alias("near"), best.alias("best")).where("near > 0").groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """The last word of each chain of forms: ``wid`` and ``root`` of every row of ``forms`` (``wid``, ``form``).

    Pointers are doubled, so a chain of length n takes about log2(n) joins; forms are ``RATIO`` times as frequent, so chains are short.
    """
    up = stored(forms.select("wid", F.col("form").alias("root")), "forms")
    while True:
        step = up.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        moved = stored(up.join(step, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return up


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form`` (its most frequent near word, if that is ``ratio`` times as frequent), ``root``, ``n``, ``n_near`` and ``form_n``."""
    best = words.join(best_neighbours(words), "wid", "left")
    fits = -F.col("best.minus_n") >= ratio * F.col("n")
    found = stored(best.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.wid")).alias("form"), F.when(fits, -F.col("best.minus_n")).alias("form_n")), "found")
    chains = roots(found.where("form is not null").select("wid", "form"))
    spelled = words.select("wid", "word")
    named = found.join(chains, "wid", "left").withColumnRenamed("form", "_form").withColumnRenamed("root", "_root")
    named = named.join(spelled.toDF("_form", "form"), "_form", "left").join(spelled.toDF("_root", "root"), "_root", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n"), F.col("n_near").cast("long").alias("n_near"), F.col("form_n"))


def digest(df: DataFrame) -> DataFrame:
    return spelling_variants(vocabulary(occurrences(df)))
