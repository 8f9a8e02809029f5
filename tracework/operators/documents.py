"""Documents: parsing, chunking, deduplication, fingerprints and conversation history."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracework.functions import text as tx
from tracework.operators.ordered import ordered_columns
from tracework.operators.windows import first_per_key
from tracework.session import spread

# Split order of the recursive chunker, header levels and cache life.
SEPARATORS = ("\n\n", "\n", " ", "")
CACHE_DAYS = 7
#: Documents whose chunks leave a task at a time.
HANDED = 64


def articles_json(df: DataFrame, payload: str) -> DataFrame:
    """One row per article with a title or content."""
    a = spread(df).withColumn("_item", F.explode(tx.article_items(F.col(payload)))).withColumn("_a", tx.article_struct(F.col("_item")))
    return a.where((F.col("_a.title") != "") | (F.col("_a.content") != "")).select(
        *[c for c in df.columns if c != payload], "_a.*")


def articles_blocks(df: DataFrame, payload: str) -> DataFrame:
    """One row per text block with a title or content, numbered per input row."""
    blocks = F.split(F.trim(F.col(payload), F.lit(" \n\t\r")), tx.BLOCK_BREAK)
    rest = [c for c in df.columns if c != payload]
    b = spread(df).select(*rest, F.posexplode(blocks).alias("block", "_b")).withColumn("_b", F.trim("_b", F.lit(" \n\t\r"))).where("_b <> ''")
    b = b.withColumn("_l", tx.block_lines(F.col("_b"))).withColumn("_a", tx.block_struct(F.col("_l")))
    return b.where((F.col("_a.title") != "") | (F.col("_a.content") != "")).select(*rest, "block", "_a.*")


def dedup_identity(df: DataFrame, url: str, title: str, order: Sequence[str]) -> DataFrame:
    """First article per identity; articles without one are dropped."""
    d = df.withColumn("identity", tx.identity(F.col(url), F.col(title))).where("identity IS NOT NULL")
    return first_per_key(d, ["identity"], order)


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size`` characters, repeating up to ``overlap`` of them."""
    out, window, total = [], [], 0
    for p in pieces:
        extra = len(sep) if window else 0
        if window and total + len(p) + extra > size:
            out.append(sep.join(window))
            while window and (total > overlap or total + len(p) + len(sep) > size):
                total -= len(window[0]) + (len(sep) if len(window) > 1 else 0)
                window.pop(0)
            extra = len(sep) if window else 0
        window.append(p)
        total += len(p) + extra
    if window:
        out.append(sep.join(window))
    return [c for c in (o.strip() for o in out) if c]


def split_recursive(text: str, size: int = 200, overlap: int = 20, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of one text: split at the coarsest separator present, finer ones only for long pieces."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1:]
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out, short = [], []
    for p in pieces:
        if len(p) <= size:
            short.append(p)
            continue
        out += _merge(short, sep, size, overlap)
        short = []
        out += split_recursive(p, size, overlap, finer) if finer else [p]
    return out + _merge(short, sep, size, overlap)


def _chunk_rows(df: DataFrame, text: str, split) -> DataFrame:
    """One row per chunk of ``split(text)``; the chunks of few documents leave the task at a time."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for at in range(0, len(s), HANDED):
                yield s.iloc[at:at + HANDED].map(lambda t: split(t or ""))

    rest = [c for c in df.columns if c != text]
    return spread(df).select(*rest, run(F.col(text)).alias("_c")).select(*rest, F.posexplode("_c").alias("chunk", "text"))


def recursive_chunks(df: DataFrame, text: str, size: int = 200, overlap: int = 20) -> DataFrame:
    """One row per chunk (one document per call, Arrow batches)."""

    return _chunk_rows(df, text, lambda t: split_recursive(t, size, overlap))


def split_separator(text: str, sep: str = "\n", size: int = 100) -> list[str]:
    """Pieces between separators, merged greedily while they fit into ``size`` characters; one pass over the text."""
    out, held, length = [], [], 0
    for piece in text.split(sep) if sep else text:
        if not piece:
            continue
        if held and length + len(sep) + len(piece) > size:
            out.append(sep.join(held))
            held, length = [], 0
        length += len(piece) + (len(sep) if held else 0)
        held.append(piece)
    out.append(sep.join(held))
    return [c for c in (c.strip(" ") for c in out) if c]


def separator_chunks(df: DataFrame, text: str, sep: str = "\n", size: int = 100) -> DataFrame:
    """Pieces between separators merged greedily up to ``size`` characters, no overlap; one row per chunk."""

    return _chunk_rows(df, text, lambda t: split_separator(t, sep, size))


def split_headers(text: str) -> list[tuple[int, str | None, str | None, str]]:
    """Number, headers and trimmed lines of the sections of one text; a first-level header also ends the second-level one."""
    out, number, first, second, body = [], 0, None, None, []

    def close() -> None:
        if body:
            out.append((number, first, second, "\n".join(body)))

    for line in map(lambda raw: raw.strip(" "), text.split("\n")):
        if not line.startswith(("# ", "## ")):
            body += [line] if line else []
            continue
        close()
        number, body = number + 1, []
        if line.startswith("# "):
            first, second = line[1:].strip(" "), None
        else:
            second = line[2:].strip(" ")
    close()
    return out


def header_sections(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Sections under '#' and '##' headers with the headers as columns; one document is one row, split where it is read."""

    @F.pandas_udf("array<struct<section:bigint,header_1:string,header_2:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("section", "header_1", "header_2", "text"), c, strict=True)) for c in split_headers(t or "")])

    return spread(df).select(*keys, F.explode(run(F.col(text))).alias("_s")).select(*keys, "_s.section", F.col("_s.header_1"), F.col("_s.header_2"), F.col("_s.text").alias("text"))


def chunk_dedup(chunks: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """First occurrence of every chunk text (by SHA-256) in file order."""
    return first_per_key(chunks.withColumn("chunk_hash", F.sha2(F.col(text), 256)), ["chunk_hash"], order)


def stale_documents(docs: DataFrame, manifest: DataFrame, id_col: str, text: str, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Documents whose fingerprint is not in the manifest or whose entry has expired."""
    fresh = manifest.where(F.col("cached_at") > now - F.expr(f"INTERVAL {days} DAYS")).select("fingerprint").distinct()
    return docs.withColumn("fingerprint", F.sha2(F.col(text), 256)).join(fresh, "fingerprint", "left_anti").drop(text)


def conversation_history(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """History seen by each turn in linear size: turns and characters before it, last question, its own answer.

    The full list for a turn is every row of the conversation with a smaller ``position``.
    """
    d = df.withColumn("_len", F.length(text).cast("long")).withColumn("_q", F.when(F.col(role) == "user", F.col(text)))
    d = ordered_columns(d, [conv], [turn], index="position", running={"_chars": "_len"}, lag={"_pt": text}, lead={"_nr": role, "_nt": text}, last={"question": "_q"})
    answer = F.when((F.col(role) == "user") & (F.col("_nr") == "assistant"), F.col("_nt"))
    return d.select(conv, turn, role, "position", (F.col("_chars") - F.col("_len")).alias("chars_before"), "question", answer.alias("answer"))


def register_chunk_udtf(spark) -> None:
    """SQL table function chunk_text(text, size, overlap)."""
    from pyspark.sql.functions import udtf

    splitter = split_recursive

    @udtf(returnType="chunk int, text string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            for i, c in enumerate(splitter(text or "", size, overlap)):
                yield i, c

    spark.udtf.register("chunk_text", ChunkText)
