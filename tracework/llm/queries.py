"""Registered queries of this subpackage, with the SQL that checks them where SQL can say it."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracework.llm import (
    curriculum, debruijn, decision_list, langid, order_minhash, spelling, subspace_join, suffix_dedup, token_alignment, token_counts, tool_chat, toxicity, trie_bpe,
)
from tracework.llm.text import lean
from tracework.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lean(prepare(spark)), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on every machine: the folder in TOKENIZER_DIR, else the installed package's."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query("op4_trie_bpe")
def op4(spark, sf_dir):
    return trie_bpe.digest(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op5_debruijn_dedup")
def op5(spark, sf_dir):
    return debruijn.digest(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


@query("op8_curriculum_mix", curriculum.SQL)
def op8(spark, sf_dir):
    return curriculum.digest(table(spark, sf_dir, "documents"))


@query("op7_order_minhash")
def op7(spark, sf_dir):
    return order_minhash.digest(table(spark, sf_dir, "documents"))


@query("op2_string_kernel_toxicity")
def op2(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_decision_list_quality")
def op3(spark, sf_dir):
    return decision_list.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_tool_call_linking", tool_chat.SQL)
def op9(spark, sf_dir):
    return tool_chat.digest(table(spark, sf_dir, "conversations"))


@query("op10_subspace_join", subspace_join.SQL)
def op10(spark, sf_dir):
    return subspace_join.digest(table(spark, sf_dir, "embeddings"))


@query("op11_token_counts")
def op11(spark, sf_dir):
    return token_counts.digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return token_alignment.digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.digest(table(spark, sf_dir, "documents"))
