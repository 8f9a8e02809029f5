"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training reads labelled rows only, at most about ``PER_LANGUAGE`` of each language (picked by a hash, so reruns agree; the bound is
the parameter ``per_language``). Each task adds up n-gram counts per language in numpy; the sums per language form the
log-probability matrix, whose size depends on the number of languages and ``BUCKETS`` alone and which is broadcast. Scoring
gathers matrix rows for the n-grams of a batch and adds them up per text, over the whole text.

Defined results: ``und`` with score 0 for null texts and texts without a letter (a character of the Unicode letter categories; number forms such as a half are none; or if no language could be learnt); ties go to
the first language in code-point order; rows that repeat are scored alike; extra columns are kept out of the result unless asked for.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.text import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 2000
PAD = "\0\0\0"


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-grams that start at each character (one column per order), and the first position of each text."""
    lower = [t.lower() + PAD for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    ids = np.empty((len(codes), len(ORDERS)), np.int32)
    h = np.zeros(len(codes), np.uint32)
    for k in range(max(ORDERS)):
        ahead = np.zeros(len(codes), np.uint32)
        ahead[: len(codes) - k] = codes[k:]
        h = (h ^ (ahead + np.uint32(k + 1))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            ids[:, ORDERS.index(k + 1)] = (h * np.uint32(0x85EBCA77)) >> np.uint32(17)
    first = np.cumsum([0, *map(len, lower)])
    return ids, first


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (``BUCKETS`` x languages; the last row holds the log priors)."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(sizes.items())])
    picked = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                ids, first = gram_ids(texts)
                for i, lang in enumerate(batch.column("lang").to_pylist()):
                    own = ids[first[i] : first[i] + len(texts[i])]
                    sums[lang] = sums.get(lang, 0) + np.bincount(own.ravel(), minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})

    found = picked.select("text", "lang").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary")
    counts = {r["lang"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in found.collect()}
    langs = sorted(counts)
    matrix = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        c = counts[lang] + 0.5
        matrix[:BUCKETS, j] = np.log(c / c.sum())
        matrix[BUCKETS, j] = np.log(sizes[lang] / sum(sizes.values()))
    return langs, matrix


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` (posterior) of each text, with the ``carry`` columns and, if asked for, the ``text``."""
    langs, matrix = model
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    rows = df.select(F.col(text_col).cast("string").alias("_text"), F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(0).alias("_carry"))

    def score(batches):
        table = shared.value
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                texts = batch.column("_text").to_pylist()
                known = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if known:
                    ids, first = gram_ids([texts[i] for i in known])
                    total = np.zeros((len(known), len(langs)))
                    step = max(1 << 12, (1 << 21) // len(langs))
                    for at in range(0, len(ids), step):  # bounded memory for any number of languages
                        to = min(at + step, len(ids))
                        a = int(np.searchsorted(first, at, "right")) - 1
                        b = int(np.searchsorted(first, to, "left"))
                        cuts = np.maximum(first[a:b], at) - at
                        for col in range(ids.shape[1]):
                            total[a:b] += np.add.reduceat(table[ids[at:to, col]], cuts, axis=0, dtype=np.float64)
                    total += table[BUCKETS]
                    best = total.argmax(1)
                    odds = np.exp(total - total.max(1, keepdims=True))
                    for i, j, s in zip(known, best, (1 / odds.sum(1)), strict=True):
                        names[i], scores[i] = langs[j], s
                kept = [batch.column("_text")] if keep_text else []
                yield pa.RecordBatch.from_arrays([batch.column("_carry"), pa.array(names), pa.array(scores), *kept], names=["_carry", "lang_pred", "score", *(["text"] if keep_text else [])])

    out = rows.mapInArrow(score, f"_carry {rows.schema['_carry'].dataType.simpleString()}, lang_pred string, score double" + ", text string" * keep_text)
    return out.select(*(["_carry.*"] if carry else []), "lang_pred", "score", *(["text"] if keep_text else []))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(df: DataFrame) -> DataFrame:
    rows = df.withColumn("_held", held_out())
    model = train(rows.where(~F.col("_held")))
    return identify(rows, model, carry=("doc_id", "_held")).withColumnRenamed("_held", "held_out")
