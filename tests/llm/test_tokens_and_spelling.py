"""Token counts, cross-tokenizer alignment and spelling variants against the libraries and brute force."""
import collections
import hashlib
import random
import re
import zlib

import pytest

from conftest import SF
from tracework.llm import order_minhash, queries, spelling, token_alignment, token_counts, trie_bpe

LONG = " ".join(f"word{i} Straße" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, _text string, n_a long, word string, wid long, key string, n_tokens long, code long"
TEXTS = [None, "", " ", "\x00", "a \x00b", "x\x00y", "don't we'll <|endoftext|>x<s> </s>", "½ ² ① Ⅷ 日本 🎉 é É ß", "  two  spaces\n\n\tand tabs ", "a" * 70_000, LONG, "▁ ▁▁", " nbsp   \x1c \x85",
         "Haus haus HAUS Häuser", "same", "same", None]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and long texts, null and repeated ids, and columns named like those of the operators."""
    rows = [(None if i == 3 else 9 if i > 13 else i, t, "en", "clash", 1, "clash", 2, "clash", 3, 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_counts(request, name):
    tokenizers = pytest.importorskip("tokenizers")
    df, path = request.getfixturevalue(name), queries.vocabulary_path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t in rows_of(df):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert ordered(token_counts.digest(df, path).collect()) == ordered(want)
    assert token_counts.digest(df.limit(0), path).collect() == []


def test_merges_of_any_bytes(monkeypatch):
    """Random words, cached and not, with a table so small that it is halved all the time."""
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path("byte_bpe_50k.json")
    lib, count = tokenizers.Tokenizer.from_file(path), token_counts.Counter(path)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 20)
    draw = random.Random(4)
    for _ in range(2000):
        text = "".join(draw.choice("aabbst'  \n\tEe0é½\x00\x85日🎉") if draw.random() < 0.97 else "<|endoftext|>" for _ in range(draw.randrange(1, 90)))
        assert count.count(text) == len(lib.encode(text, add_special_tokens=False).ids), text


def reference_alignment(rows, path_a, path_b):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a_lib, b_lib = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a_lib.encode_special_tokens = True
    byte = {s: b for b, s in enumerate(token_counts.byte_symbols())}

    def spans(pieces):
        at, out = 0, []
        for i, p in pieces:
            out.append((at, at + len(p), i))
            at += len(p)
        return out

    def one(text):
        if not text:
            return None
        a = [(i, bytes(byte[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)]
        want = (" " + text).encode()
        if b"".join(p for _, p in a) != want or b"".join(p for _, p in b) != want:
            return None
        a, b = spans(a), spans(b)
        links, low = [], 0
        for start, end, i in a:
            while b[low][1] <= start:
                low += 1
            j = low
            while j < len(b) and b[j][0] < end:
                links.append((i, b[j][2]))
                j += 1
        groups, x, y = [], 0, 0
        for cut in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            part = ([], [])
            while x < len(a) and a[x][1] <= cut:
                part[0].append(str(a[x][2]))
                x += 1
            while y < len(b) and b[y][1] <= cut:
                part[1].append(str(b[y][2]))
                y += 1
            groups.append("|".join(map(",".join, part)))
        return len(a), len(b), groups, links

    found = [(i, one(t)) for i, t in rows]
    counts = collections.Counter(pair for _, f in found if f for pair in f[3])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("block", [token_alignment.BLOCK, 1])
def test_alignment(request, monkeypatch, name, block):
    pytest.importorskip("sentencepiece")
    df = request.getfixturevalue(name)
    paths = queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")
    monkeypatch.setattr(token_alignment, "BLOCK", block)
    want, counts = reference_alignment(rows_of(df), *paths)
    assert ordered(token_alignment.digest(df, *paths).collect()) == ordered(want)
    if name == "odd":
        assert {(r.a, r.b): r.n for r in token_alignment.pair_counts(df, *paths).collect()} == counts
        assert token_alignment.digest(df.limit(0), *paths).collect() == []


def variants(rows, least=5):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    near = collections.defaultdict(set)
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for i in range(len(w) + 1):
            edits |= {w[:i] + c + w[i:] for c in spelling.LETTERS} | ({w[:i] + c + w[i + 1 :] for c in spelling.LETTERS} if i < len(w) else set())
        near[w] = {v for v in edits if v in words and v != w}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return [(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()], near


def family():
    """Made-up words of few letters: many neighbours, runs of one letter, ties, chains of forms, depths beyond the directly numbered ones."""
    draw = random.Random(7)
    words = ["aabbaa", "aaabbaa", "aabaa" * 5, "aabaa" * 5 + "a", "b" + "aabaa" * 5, "aabaa" * 2 + "c" + "aabaa" * 3, "ÀÉßøþÿ", "Éßøþÿà", "×÷×÷×÷", "z" * 3000, "z" * 3001, "z" * 2999 + "y"]
    words += {"".join(draw.choice("ab") for _ in range(draw.choice((6, 7, 12)))) for _ in range(400)}
    return [(i, " ".join([w] * draw.choice((5, 5, 6, 25, 30, 130, 700))) + " Ab-cd") for i, w in enumerate(words)]


def test_spelling_on_families(spark):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, near = variants(rows)
    assert ordered(spelling.digest(df).collect()) == ordered(want)
    assert sum(w[1] is not None for w in want) > 30 and any(w[2] not in (w[0], w[1]) for w in want)
    words = spelling.vocabulary(spelling.occurrences(df))
    name = {r.wid: r.word for r in words.collect()}
    got = [(name[r.wid], name[r.near]) for r in spelling.neighbours(words).collect()]
    assert sorted(got) == sorted((w, v) for w, others in near.items() for v in others)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_spelling(request, name):
    df = request.getfixturevalue(name)
    assert ordered(spelling.digest(df).collect()) == ordered(variants(rows_of(df))[0])
    assert spelling.digest(df.limit(0)).collect() == []


def test_bpe_of_nul_characters(odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [t for _, t in rows_of(odd)] + ["\0<|endoftext|>", "\0\0", "<|startoftext|>\0a"]
    assert trie_bpe.Encoder(path).encode(texts) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert trie_bpe.digest(odd, path).count() == len(TEXTS)


def test_few_pivots_for_a_family():
    """A family of texts that share most buckets is compared with few pivots, not with one per bucket."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    draw = random.Random(2)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for _ in range(400):
        t = list(base)
        for at in draw.sample(range(150), 3):
            t[at] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(t))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = order_minhash.classes(order_minhash.keyed(made, "doc_id", "text"))
    members = rows.selectExpr("k", "explode(array_distinct(keys)) key")
    pairs, _ = order_minhash._pivots(members, 0)
    assert pairs.count() < 15 * len(texts)
