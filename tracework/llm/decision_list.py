"""Quality rules: text statistics and a learned decision list over them.

Statistics are counted over whole texts in numpy batches. Sequential covering then learns, from labelled statistics (at most about
``TRAIN_ROWS`` rows, picked by hash), an ordered list of threshold conjunctions for low quality: each rule grows by the condition of
best information gain on two thirds of the rows, loses the end conditions that do not help on the rest, and is taken if it is
precise there; what it covers is set aside before the next rule. The list becomes one ordered Spark conditional.

Defined results: null and empty texts have all counts 0 and fail the base test; labels that are null or contradict each other count as
low quality if any is 0; without labels the list is empty and keeps what passes the base; extra columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.llm.repeats import stored
from tracework.llm.text import BYTES, PIECE, Prefix, buffer_of, mix, slices, words

TRAIN_ROWS = 20_000
MIN_WORDS, REPEAT_SHARE = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, LOWER, PUNCT, DIGIT = (np.zeros(256, bool) for _ in range(4))
UPPER[0x41:0x5B] = LOWER[0x61:0x7B] = DIGIT[0x30:0x3A] = True
PUNCT[list(b"!?.,;:")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_punct", "n_bang", "n_digits", "n_distinct", "most_frequent")
#: Features of the rules, as shares of what they can reach.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"), "upper_share": ("n_upper", "word_chars"), "lower_share": ("n_lower", "word_chars"), "bang_per_word": ("n_bang", "n_words"),
    "punct_per_word": ("n_punct", "n_words"), "digit_share": ("n_digits", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"), "top_word_share": ("most_frequent", "n_words"), "mean_word": ("word_chars", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def _repeats(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes grouped by row: how often each occurs in its row, and its occurrence number."""
    own = mix(values ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(own)))
    count, number = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    count[order] = np.repeat(size, size)
    number[order] = np.arange(len(own)) - np.repeat(begin, size)
    return count, number


def _line_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + PIECE, "right")), i + 1)
        low = start[i]
        out[i:j] = Prefix(BYTES[0][raw[low : end[j - 1]]]).ranges(start[i:j] - low, end[i:j] - low)
        i = j
    return out


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    raw, offsets = buffer_of(column)
    n = len(offsets) - 1
    start, end, hashes, bounds = words(raw, offsets)
    n_words = np.diff(bounds)
    word_row = np.repeat(np.arange(n), n_words)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = {"n_words": n_words}
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    out["word_chars"] = np.bincount(word_row, points[end] - points[start], minlength=n).astype(np.int64)
    out["n_symbols"], out["n_upper"], out["n_lower"] = per_row(SYMBOLS[raw]), per_row(UPPER[raw]), per_row(LOWER[raw])
    out["n_punct"], out["n_digits"], out["n_bang"] = per_row(PUNCT[raw]), per_row(DIGIT[raw]), per_row(raw == 0x21)
    # lines with a word
    breaks = np.flatnonzero(raw == 0x0A)
    low = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    low = np.unique(low[low < len(raw)])
    line_row = np.searchsorted(offsets, low, "right") - 1
    next_break = np.append(breaks, len(raw))[np.searchsorted(breaks, low, "left")]
    high = np.minimum(next_break, offsets[line_row + 1])
    first_word = np.searchsorted(start, low, "left")
    has = (first_word < len(start)) & (np.append(start, len(raw))[first_word] < high) if len(low) else np.zeros(0, bool)
    low, high, line_row = low[has], high[has], line_row[has]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    _, number = _repeats(_line_hashes(raw, low, high), line_row)
    out["n_dup_lines"] = np.bincount(line_row, number > 0, minlength=n).astype(np.int64)
    # words in three-word windows that occur twice
    grams = Prefix(hashes).grams(3)
    covered = np.zeros(len(hashes) + 3, np.int64)
    if len(grams):
        at = np.flatnonzero(word_row[: len(grams)] == word_row[2 : 2 + len(grams)])
        count, _ = _repeats(grams[at], word_row[at])
        twice = at[count > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    out["n_repeat_words"] = np.bincount(word_row, np.cumsum(covered)[: len(hashes)] > 0, minlength=n).astype(np.int64)
    count, number = _repeats(hashes, word_row)
    out["n_distinct"] = np.bincount(word_row, number == 0, minlength=n).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, word_row, count)
    out["most_frequent"] = most
    return out


def statistics(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id`` and all ``COUNTS`` of each whole text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text", PIECE):
                found = counts_of(batch.column("_text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["id", *COUNTS])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.name) >= self.threshold if self.at_least else feature(self.name) < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.at_least else x[self.name] < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.threshold:.4g}"


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int = 4) -> list[Condition]:
    """Add the condition of best information gain until no good row is left."""
    rule: list[Condition] = []
    while len(rule) < most:
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        if not n or not p:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name in x:
            v = x[name][rows]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])):
                for up in (True, False):
                    hit = v >= t if up else v < t
                    hp = (hit & bad[rows]).sum()
                    hn = hit.sum() - hp
                    if hp and (gain := hp * (np.log2(hp / (hp + hn)) - base)) > best[0]:
                        best = (gain, Condition(name, up, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows[best[1].holds({k: v[rows] for k, v in x.items()})]
    return rule


def _covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, least_precision: float = 0.9) -> list[list[Condition]]:
    """Ordered rules for ``bad`` rows by sequential covering; row order decides the split between growing and pruning."""
    left = np.arange(len(bad))
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and bad[left].sum() >= 10:
        prune = left[left % 3 == 0]
        rule = _grow(x, bad, left[left % 3 != 0])
        if not rule:
            break
        sub, wrong = {k: v[prune] for k, v in x.items()}, bad[prune]

        def worth(r, sub=sub, wrong=wrong):
            hit = _covers(r, sub)
            return (wrong[hit].sum() - (~wrong[hit]).sum()) / max(1, hit.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _covers(rule, sub)
        if hit.sum() < 3 or wrong[hit].mean() < least_precision:
            break
        rules.append(rule)
        left = left[~_covers(rule, {k: v[left] for k, v in x.items()})]
    return rules


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Learn the list from statistics of labelled rows (label 0: low quality)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) == 0).alias("bad"))
    share = min(1.0, train_rows / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).join(stats, "id").where(~base_failed())
    table = rows.select("id", "bad", *[feature(f).alias(f) for f in FEATURES]).toPandas().sort_values("id")
    if not len(table):
        return []
    return learn({f: table[f].to_numpy() for f in FEATURES}, table["bad"].to_numpy(bool))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def verdict(rules: list[list[Condition]]) -> Column:
    """The first rule that applies rejects; what none covers is kept."""
    out, chain = F.lit(True), None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        chain = F.when(test, False) if chain is None else chain.when(test, False)
    return out if chain is None else chain.otherwise(True)


def digest(df: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(statistics(df), "statistics")
    rules = fit(stats, labels)
    return stats.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
