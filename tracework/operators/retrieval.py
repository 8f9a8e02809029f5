"""Lexical and hybrid retrieval with block-local top-k."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tracework.operators.windows import top_k
from tracework.session import materialise, spread

# Ranking constants of the public BM25 (Okapi) and reciprocal-rank formulas.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_C = 60
WEIGHTS = (0.4, 0.6)
#: Query tokens that are shipped at a time, texts scored at a time, terms a task counts before it hands its counts on.
QUERY_TOKENS, DOC_BLOCK, HELD_TERMS = 1_000_000, 2048, 500_000


def tokens(text: Column) -> Column:
    """Whitespace tokens, case kept."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


SPLIT = re.compile(r"[ \t\n\x0b\f\r]+")


def _words(text: str | None) -> list[str]:
    return [w for w in SPLIT.split(text or "") if w]


def _frequencies(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold each term, counted in the task; the row without a term has the number of texts and of tokens."""
    def out() -> pd.DataFrame:
        return pd.DataFrame({"term": [None, *found], "df": [texts, *found.values()], "size": [size, *([0] * len(found))]})

    found, texts, size = Counter(), 0, 0
    for pdf in frames:
        for text in pdf["text"]:
            words = _words(text)
            texts, size = texts + 1, size + len(words)
            found.update(set(words))
        if len(found) > HELD_TERMS:
            yield out()
            found, texts, size = Counter(), 0, 0
    yield out()


class _Best:
    """The k best documents of each query so far."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query: int, ids: np.ndarray, score: np.ndarray) -> None:
        keep = np.lexsort((ids, -score))[: self.k]
        have = self.found.get(query)
        if have is not None:
            ids, score = np.concatenate([have[0], ids[keep]]), np.concatenate([have[1], score[keep]])
            keep = np.lexsort((ids, -score))[: self.k]
        self.found[query] = ids[keep], score[keep]

    def frame(self) -> pd.DataFrame:
        rows = [(np.full(len(i), q), i, v) for q, (i, v) in self.found.items()]
        cells = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "score"), cells, strict=True)))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k documents per query: query_id, doc_id, score, rank.  Inputs: id, text.

    Two passes over the texts and no table of postings.  The first counts in how many texts each term occurs, inside the tasks.
    For the second the queries, with the weights of their terms, are shipped to the tasks that read the texts, in blocks of at most
    ``QUERY_TOKENS`` tokens; a task weighs only terms of the queries, text block by text block, and hands on its k best per query.
    """
    spark = docs.sparkSession
    texts = spread(docs.select("id", "text"))
    df = materialise(texts.select("text").mapInPandas(_frequencies, "term string, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")), "terms")
    whole = df.where("term IS NULL").select("df", "size").first()
    n, avgdl = (whole["df"], whole["size"] / max(whole["df"], 1)) if whole else (0, 0.0)
    raw = F.ln(F.lit(float(n)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    idf = df.where("term IS NOT NULL").select("term", raw.alias("raw"))
    mean = idf.agg(F.avg("raw")).first()[0]
    size = F.greatest(F.size(tokens(F.col("text"))), F.lit(1))
    q = queries.where("text IS NOT NULL").select(F.col("id").alias("query_id"), "text", size.cast("long").alias("size"))
    blocks = max(1, -(-(q.agg(F.sum("size")).first()[0] or 0) // QUERY_TOKENS))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    terms = q.select("query_id", "block", F.explode(tokens(F.col("text"))).alias("term")).groupBy("block", "query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weight = F.when(F.col("raw") < 0, F.lit(mean) * EPSILON).otherwise(F.col("raw"))
    terms = materialise(terms.join(idf, "term").select("block", "query_id", "term", "qtf", weight.alias("idf")), "query-terms")
    found = None
    for block in range(blocks):
        pdf = terms.where(F.col("block") == block).toPandas().sort_values(["query_id", "term"])
        code, names = pd.factorize(pdf["term"])
        weights = np.zeros(len(names))
        weights[code] = pdf["idf"]
        ids, edge = np.unique(pdf["query_id"].to_numpy(), return_index=True)
        asked = list(zip(ids.tolist(), np.split(code, edge[1:]), np.split(pdf["qtf"].to_numpy(float), edge[1:]), strict=True)) if len(pdf) else []
        shipped = spark.sparkContext.broadcast(({t: i for i, t in enumerate(names)}, weights, asked))

        def score(frames: Iterable[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            index, idf_of, queries_ = shipped.value
            best = _Best(k)
            for pdf in frames:
                for at in range(0, len(pdf), DOC_BLOCK):
                    part = pdf.iloc[at:at + DOC_BLOCK]
                    ids = part["id"].to_numpy()
                    words = [_words(t) for t in part["text"]]
                    counts = [Counter([w for w in ws if w in index]) for ws in words]
                    row = np.repeat(np.arange(len(part)), [len(c) for c in counts])
                    term = np.array([index[w] for c in counts for w in c], np.int64)
                    tf = np.array([t for c in counts for t in c.values()], float)
                    dl = np.array([len(ws) for ws in words], float)
                    w = idf_of[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl)) if len(term) else np.zeros(0)
                    order = np.argsort(term, kind="stable")
                    row, w = row[order], w[order]
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf_of)))])
                    for query, its, qtf in queries_:
                        total, hit = np.zeros(len(part)), np.zeros(len(part), bool)
                        for i, many in zip(its, qtf):
                            here = slice(cuts[i], cuts[i + 1])
                            total[row[here]] += many * w[here]
                            hit[row[here]] = True
                        cand = np.flatnonzero(hit)
                        if len(cand):
                            best.add(query, ids[cand], np.round(total[cand], 9))
            yield best.frame()

        part = texts.mapInPandas(score, "query_id bigint, doc_id bigint, score double")
        found = part if found is None else found.union(part)
    return top_k(found, "score", k, "doc_id", ["query_id"])


def hybrid(lists: list[DataFrame], weights=WEIGHTS, c: int = RRF_C, k: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (query_id, doc_id, rank): one union, one aggregation."""
    parts = [d.select("query_id", "doc_id", (F.lit(w) / (F.col("rank") + c)).alias("s")) for d, w in zip(lists, weights)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))
    fused = fused.withColumn("score", F.round(F.col("score") * 1e12) / 1e12)
    return top_k(fused, "score", k, "doc_id", ["query_id"]) if k else fused


def context(ranked: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """Texts of the k best documents joined by a blank line in rank order (k is small and fixed)."""
    t = ranked.where(F.col("rank") <= k).join(docs.select(F.col("id").alias("doc_id"), "text"), "doc_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    return t.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


@F.pandas_udf(ArrayType(DoubleType()))
def _letters(texts: pd.Series) -> pd.Series:
    count = lambda t: None if t is None else np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[97:123].astype(float)
    return pd.Series([count(t) for t in texts], dtype=object)


def letter_profile(text: Column) -> Column:
    """26 letter counts of a text, in one pass: a cheap vector that needs no model."""
    return _letters(F.lower(text))
