"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

Kernel. Two strings are alike by the subsequences of ``LENGTH`` characters they share, each weighed down by ``DECAY`` per character it
spans, so characters put into an insult lower its value without hiding it. Words are compared as ``^letters$``; runs of single characters
("a b c d") count as one more word; long words are cut into overlapping pieces.

Landmarks are character strings chosen from a bounded sample of labelled texts: those that nearly only toxic texts contain, greedily, until
they cover the toxic texts. A text is described by its best kernel value for each landmark, above the level ``CHANCE`` that any long text reaches; the inverse root of the landmarks' own
kernel matrix turns that into Nyström coordinates, on which a linear squared-hinge machine is fitted; a logistic curve maps its margin
to a score.

Defined results: null and empty texts score like texts without any likeness to a landmark; without toxic labels every score is 0;
labels that contradict each other count as toxic; extra columns are ignored; rows that repeat are scored alike.
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.repeats import stored
from tracework.llm.text import PIECE, slices

LENGTH, DECAY = 4, 0.5
GRAM = 5
CHANCE = 0.3
LANDMARKS = 24
TRAIN_ROWS = 12_000
LONGEST, STRIDE = 24, 12
CACHE_WORDS = 100_000
THRESHOLD = 0.3
SPACED = re.compile(r"(?<!\S)\w(?:\s+\w(?!\S)){3,}")


def marked(word: str) -> str:
    """The letters and digits of a word between start and end marks; marks put between them are dropped."""
    inner = word if word.isalnum() else "".join(filter(str.isalnum, word))
    return f"^{inner}$" if inner else ""


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and spelled-out runs of single characters as one word."""
    if not text:
        return set()
    lower = text.lower()
    out = set(lower.split())
    for run in SPACED.findall(lower):
        out.add(re.sub(r"\s+", "", run))
    return out


def codes(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words by length class, as (positions, character matrix); words longer than ``LONGEST`` give several rows."""
    by: dict[int, tuple[list[int], list[str]]] = {}
    out, at, parts = [], [], []
    for i, w in enumerate(words):
        if len(w) <= LONGEST:
            width = max(4, (len(w) + 3) // 4 * 4)
            rows = by.setdefault(width, ([], []))
            rows[0].append(i)
            rows[1].append(w.ljust(width, "\0"))
            continue
        n = -(-(len(w) - STRIDE) // STRIDE)
        whole = np.zeros((n - 1) * STRIDE + LONGEST, np.uint32)
        whole[: len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        parts.append(np.lib.stride_tricks.sliding_window_view(whole, LONGEST)[::STRIDE])
        at.append(np.full(n, i))
    for width, (where, texts) in by.items():
        out.append((np.array(where), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)))
    if parts:
        out.append((np.concatenate(at), np.concatenate(parts)))
    return out


def kernel(chars: np.ndarray, landmark: str | np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Gapped-subsequence kernel of each row of ``chars`` with one landmark, by the usual recursion over prefixes.

    A matrix of as many rows gives each row its own landmark.
    """
    n, width = chars.shape
    mark = np.frombuffer(landmark.encode("utf-32-le"), np.uint32) if isinstance(landmark, str) else landmark.T
    d, d2 = np.float32(decay), np.float32(decay * decay)
    equal = [[chars[:, j] == c for c in mark] for j in range(width)]
    zero = np.zeros(n, np.float32)
    before = [[d2] * len(mark) for _ in range(width)]  # weight of what ends before (j, k)
    for q in range(length):
        here = [[np.where(equal[j][k], before[j][k], np.float32(0)) for k in range(len(mark))] for j in range(width)]
        if q == length - 1:
            return sum(sum(row) for row in here)
        below = [zero] * len(mark)
        following = [[zero] * len(mark) for _ in range(width)]
        for j in range(width):
            line: list[np.ndarray] = []
            for k in range(len(mark)):
                value = here[j][k] + d * below[k]
                if k:
                    value = value + d * line[k - 1] - d2 * below[k - 1]
                line.append(value)
            if j + 1 < width:
                following[j + 1] = [zero, *[d2 * v for v in line[:-1]]]
            below = line
        before = following
    return zero


def common(symbols: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``symbols`` with one landmark (at most 63 symbols), bit-parallel."""
    m = len(landmark)
    kind = np.uint8 if m < 8 else np.uint64
    masks = np.zeros(int(max(symbols.max(initial=0), landmark.max(initial=0))) + 1, kind)
    for k, c in enumerate(landmark.tolist()):
        masks[c] |= kind(1 << k)
    found = masks[symbols]
    full = np.full(len(symbols), (1 << m) - 1, kind)
    state = full.copy()
    for j in range(symbols.shape[1]):
        hit = state & found[:, j]
        state = ((state + hit) | (state - hit)) & full
    return m - np.bitwise_count(state)


def likeness(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words with landmarks, over each landmark's value with itself."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    marks = [np.frombuffer(m.encode("utf-32-le"), np.uint32) for m in landmarks]
    used = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint32)
    own = np.array([kernel(m.reshape(1, -1), text)[0] for m, text in zip(marks, landmarks, strict=True)], np.float32)
    for at, chars in codes(words):
        # characters of any landmark by number, all others 0
        place = np.searchsorted(used, chars)
        symbols = np.where(used[np.minimum(place, len(used) - 1)] == chars, place + 1, 0)
        # rows without a common subsequence of LENGTH characters have kernel value 0; the others go together, by landmark length
        pairs: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, mark in enumerate(marks):
            rows = np.flatnonzero(common(symbols, np.searchsorted(used, mark) + 1) >= LENGTH)
            if len(rows):
                pairs.setdefault(len(mark), []).append((k, rows))
        for found in pairs.values():
            rows = np.concatenate([r for _, r in found])
            which = np.repeat([k for k, _ in found], [len(r) for _, r in found])
            values = kernel(chars[rows], np.array([marks[k] for k, _ in found])[np.repeat(np.arange(len(found)), [len(r) for _, r in found])])
            np.maximum.at(out, (at[rows], which), values / own[which])
    return out


class Describer:
    """Best likeness of each text's words to each landmark; words met before are looked up, and only likely words have a row."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.landmarks)), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        bags = [words_of(t) for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.forget()
        new = set().union(*bags) - self.place.keys()
        forms = {w: marked(w) for w in new}
        distinct = sorted({f for f in forms.values() if f})
        values = likeness(distinct, self.landmarks)
        likely = np.flatnonzero((values > CHANCE).any(1))
        at = {distinct[i]: len(self.rows) + n for n, i in enumerate(likely.tolist())}
        self.rows = np.concatenate([self.rows, values[likely]])
        for w, f in forms.items():
            self.place[w] = at.get(f, 0)
        out = np.zeros((len(texts), len(self.landmarks)))
        for i, bag in enumerate(bags):
            hits = set(map(self.place.__getitem__, bag))
            hits.discard(0)
            if hits:
                out[i] = self.rows[sorted(hits)].max(0)
        # values below CHANCE are what any long text reaches; above 1 a word holds the landmark whole
        return (np.clip(out, CHANCE, 1) - CHANCE) / (1 - CHANCE)


_LAST: list[Describer] = []


def describer_of(landmarks: list[str]) -> Describer:
    """The describer of this worker process: later tasks of the same model find the words of earlier ones."""
    if not _LAST or _LAST[0].landmarks != landmarks:
        _LAST[:] = [Describer(landmarks)]
    return _LAST[0]


def coordinates(described: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Nyström coordinates and, so that one insult in a text weighs as much as several, the best likeness to any landmark."""
    return np.column_stack([described @ root, 4 * described.max(1, initial=0)])


@dataclass
class Model:
    landmarks: list[str]
    root: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, described: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(described))
        margin = coordinates(described, self.root) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _landmarks(sample: DataFrame) -> list[str]:
    """Strings that mark toxic texts, chosen greedily by the words of toxic texts they add."""
    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    forms = [marked(w) for w in words_of(text)]
                    seen[toxic].update({f[a : a + GRAM] for f in forms for a in range(max(1, len(f) - GRAM + 1)) if len(f) > 3})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([seen[y][g] for g in names], pa.int64()) for y in (1, 0)]], names=["gram", "toxic", "clean"])

    sums = sample.mapInArrow(count, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = [r["gram"] for r in sums.where("toxic >= 4 and toxic >= 9 * clean").orderBy(F.desc(F.col("toxic") - 9 * F.col("clean")), "gram").limit(1000).collect()]
    if not best:
        return []
    index = {g: i for i, g in enumerate(best)}

    def held(batches):
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                lists = []
                for text in batch.column("text").to_pylist():
                    forms = [marked(w) for w in words_of(text)]
                    found = ({index[g] for a in range(max(1, len(f) - GRAM + 1)) if (g := f[a : a + GRAM]) in index} for f in forms)
                    lists.append([sorted(x) for x in found if x])
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.list_(pa.int32())))], names=["held"])

    # one entry per word of a toxic text: a chosen string settles the words it occurs in, so each insult gets its own
    rows = [w for r in sample.where("toxic = 1").mapInArrow(held, "held array<array<int>>").collect() for w in r["held"]]
    chosen: list[int] = []
    least = max(3, len(rows) // 200)
    while len(chosen) < LANDMARKS:
        gain = np.bincount([i for r in rows for i in r], minlength=len(best))
        if gain.max() < least:
            break
        pick = int(gain.argmax())
        chosen.append(pick)
        rows = [r for r in rows if pick not in r]
    return [best[i] for i in chosen]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float, float, float]:
    """Squared-hinge machine by Newton steps with classes weighed evenly, then a logistic curve over its margin."""
    ones = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y, 1.0, -1.0)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    w = np.zeros(ones.shape[1])
    penal = np.eye(len(w)) * ridge
    penal[-1, -1] = 1e-9
    for _ in range(50):
        slack = 1 - sign * (ones @ w)
        active = slack > 0
        a = ones[active] * share[active, None]
        step = np.linalg.solve(penal + a.T @ ones[active], a.T @ sign[active]) - w
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    margin = ones @ w
    k, c = 1.0, 0.0
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(k * margin + c, -500, 500)))
        g = np.array([((p - goal) * margin).sum(), (p - goal).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        k, c = k - step[0], c - step[1]
    return w[:-1], float(w[-1]), float(k), float(c)


def train(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on a hash sample of about ``train_rows`` labelled texts (columns ``doc_id``, ``text``; ``doc_id``, ``toxic``)."""
    nothing = Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, 0.0)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, train_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # the sample's size is bounded by train_rows, so its ids may be sent to every task
    sample = stored(df.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic"), "toxic-sample")
    landmarks = _landmarks(sample)
    if not landmarks:
        return nothing
    own = likeness(landmarks, landmarks).astype(float)
    scale = np.sqrt(np.array([kernel(np.frombuffer(m.encode("utf-32-le"), np.uint32).reshape(1, -1), m)[0] for m in landmarks], float))
    gram = own * scale[None, :] / scale[:, None]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    def describe(batches):
        describer = describer_of(landmarks)
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(describer(batch.column("text").to_pylist())), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(describe, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] > 0 for r in rows])
    if y.all() or not y.any():
        return nothing
    return Model(landmarks, root, *_fit(coordinates(x, root), y))


def score(df: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score`` of each whole text, with the ``carry`` columns."""
    rows = df.select(F.col(text_col).cast("string").alias("_text"), F.struct(*[F.col(c) for c in carry]).alias("_carry"))

    def run(batches):
        describer = describer_of(model.landmarks)
        for whole in batches:
            for batch in slices(whole, "_text", PIECE):
                texts = batch.column("_text").to_pylist()
                values = model.score(describer(texts)) if model.landmarks else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("_carry"), pa.array(values)], names=["_carry", "score"])

    return rows.mapInArrow(run, f"_carry {rows.schema['_carry'].dataType.simpleString()}, score double").select("_carry.*", "score")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(df: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(df, labels.where(~held_out()))
    rows = df.select("doc_id", "text", held_out().alias("held_out"))
    return score(rows, model, carry=("doc_id", "held_out")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
