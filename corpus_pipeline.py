"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, repeated passages, source mix, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; ``run`` writes every stage as Parquet and reads
it again. All stages but the last return the columns they were given. Rows that repeat id and text are one document from the
second stage on; null texts are rejected by the first; an empty table passes through as an empty table.
Extra columns are kept, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracework.llm import curriculum, debruijn, langid, order_minhash, trie_bpe
from tracework.llm.queries import table, vocabulary_path
from tracework.llm.repeats import stored
from tracework.llm.text import lean
from tracework.session import prepare

#: Posterior below which a language is not believed.
LEAST_SCORE = 0.5
#: SQL cannot express a trained classifier, sketches or BPE.
ORACLE_SQL = None


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one struct column ``_row`` beside copies of ``columns``, so that no column of theirs meets one that a stage adds."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *[F.col(c) for c in columns])


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of ``_row``, those named in ``changed`` replaced."""
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, or of no clear language, go."""
    lean(spark)
    model = langid.train(docs.where(~langid.held_out()))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("_row"), "text")
    found = langid.identify(rows, model, carry=("_row",), keep_text=True)
    return _unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, text=F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    lean(spark)
    kept = order_minhash.near_duplicates(docs).where("kept").select(F.col("id").alias("_kept"), F.col("_h").alias("_kept_h"))
    rows = _whole(docs, "doc_id").withColumn("_h", F.xxhash64(F.col("_row")["text"].cast("string")))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_kept"]) & (rows["_h"] == kept["_kept_h"]), "left_semi")
    return _unpacked(rows.dropDuplicates(["doc_id", "_h"]), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word passages that occur elsewhere; untouched texts stay byte for byte."""
    lean(spark)
    others = [c for c in docs.columns if c != "text"]
    out = debruijn.remove_repeats(docs.select(F.struct(*others).alias("_row"), "doc_id", "text"), carry=("_row",))
    cut = F.size("removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return _unpacked(out, docs, **changed)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, as often as the mix takes them."""
    return _unpacked(curriculum.mixed(_whole(docs, "doc_id", "text", "source"), carry=("doc_id", "_row")), docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the token ids and of the decoded text."""
    lean(spark)
    return trie_bpe.digest(docs, vocabulary_path(), carry=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
