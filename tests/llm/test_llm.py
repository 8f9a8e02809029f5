"""Operators for training-data corpora against brute force, exact round trips and edge cases."""
import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest

from conftest import SF
from tracework.llm import curriculum, debruijn, decision_list, langid, order_minhash, queries, subspace_join, suffix_dedup, tool_chat, toxicity, trie_bpe

LONG = " ".join(f"w{i}" for i in range(400))
SHARED = " ".join(f"s{i}" for i in range(80))
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, LONG, "en", None), (5, LONG, "en", "b"), (5, LONG, "en", "b"),
       (None, "x y z " * 50, None, "b"), (6, "start " + SHARED + " end", "en", "a"), (7, "other " + SHARED + " stop", "en", "a"),
       (8, "q" * 3000, "de", "a"), (9, "\n".join(["same line"] * 5), "fr", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], SCHEMA + ", _id string, size int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def cover(rows, window, cut, join):
    """Per row: units, removed units and hash of what is left, with every repeated window removed."""
    texts = [(i, cut((t or "").encode())) for i, t in rows]
    seen = collections.Counter(bytes(join(u[p : p + window])) for _, u in texts for p in range(len(u) - window + 1))
    out = []
    for i, u in texts:
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if seen[bytes(join(u[p : p + window]))] > 1:
                gone[p : p + window] = [True] * window
        out.append((i, len(u), sum(gone), hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["docs", "odd"])
@pytest.mark.parametrize("limit", [suffix_dedup.BUCKET_BYTES, 0])
def test_suffix_dedup(request, monkeypatch, name, limit):
    df = request.getfixturevalue(name)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", limit)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digest(df).collect()), key=repr)
    assert got == cover(rows_of(df), 200, list, bytes)


def test_suffix_dedup_keeps_first(odd):
    out = {r["id"]: r for r in suffix_dedup.suffix_dedup(odd).collect() if r["id"] in (4, 6, 7, 8)}
    assert out[4]["removed"] == [] and out[6]["removed"] == [] and len(out[7]["removed"]) == 1
    assert bytes(out[8]["kept"]) == b"q"  # every window but the first repeats an earlier one


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_debruijn(request, name):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in debruijn.digest(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == cover(rows_of(df), 35, bytes.split, b" ".join)


def test_debruijn_paths(odd):
    paths = {(r["id"], r["first_word"], r["end_word"]) for r in debruijn.repeat_paths(odd).collect() if r["id"] in (6, 7)}
    assert paths == {(6, 1, 81), (7, 1, 81)}


def test_order_minhash(spark, docs, odd):
    base = [f"t{i}" for i in range(200)]
    near = base[:100] + ["new"] + base[101:]
    far = base[100:] + base[:100] + [f"u{i}" for i in range(100)]
    made = spark.createDataFrame([(1, " ".join(base)), (2, "  ".join(base)), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, "a b")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.group_id, r.kept) for r in order_minhash.digest(made).collect()}
    assert got[2] == (1, 1, False) and got[3] == (3, 1, False) and got[1] == (1, 1, True)
    assert got[4] == (4, 4, True) and got[6] == (5, 5, False) and got[7] == (7, 7, True)
    assert order_minhash.digest(odd).count() == len(ODD) - 1  # the wholly repeated row is one document
    assert order_minhash.digest(docs.limit(0)).count() == 0


def test_order_minhash_inside_a_template(spark):
    """300 pages that share 348 of 400 words, every tenth with a near copy that differs in its own part: brute force on all pairs."""
    shared = [f"s{i}" for i in range(348)]
    pages = []
    for i in range(300):
        pages.append(shared + [f"p{i}_{j}" for j in range(52)])
        if i % 10 == 0:
            pages.append(pages[-1][:362] + [f"q{i}_{j}" for j in range(38)])
    codes = {w: i for i, w in enumerate({w for p in pages for w in p})}
    seqs = [np.array([codes[w] for w in p], np.uint32) for p in pages]
    root = list(range(len(pages)))
    for a in range(len(pages)):
        for b in range(a):
            if root[a] != root[b] and order_minhash.similar(seqs[a], seqs[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert len(set(root)) == 300
    made = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pages)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in order_minhash.digest(made).collect()}
    assert [got[i] for i in range(len(pages))] == root


def test_alignment_finds_shortest_script():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.integers(0, 4, rng.integers(1, 30))
        b = rng.integers(0, 4, rng.integers(1, 30))
        lcs = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if a[i] == b[j] else max(lcs[i, j + 1], lcs[i + 1, j])
        assert sum(order_minhash.alignment(a, b, len(a) + len(b))) == lcs[-1, -1]
        d = len(a) + len(b) - 2 * lcs[-1, -1]
        assert d == 0 or order_minhash.alignment(a, b, d - 1) is None


def test_bpe_equals_library(docs, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [t for _, t in rows_of(docs) + rows_of(odd)] + ["", "don't <|endoftext|>x", "日本 é 12 Å", "annananan RRRR !!..", "ǅ İ"]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert trie_bpe.Encoder(path).encode(texts) == want
    got = {r.doc_id: r for r in trie_bpe.digest(docs, path).collect()}
    ids = {r.doc_id: r.ids for r in trie_bpe.encode(docs, path).collect()}
    back = {r.doc_id: r.decoded for r in trie_bpe.decode(trie_bpe.encode(docs, path), path).collect()}
    for (i, _), w in zip(rows_of(docs), want, strict=False):
        text = lib.decode(w, skip_special_tokens=False)
        assert ids[i] == w and back[i] == text and got[i].n_tokens == len(w)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert trie_bpe.digest(odd, path).count() == len(ODD)


def test_language_id(spark, odd, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.digest(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    none = {r.doc_id: (r.lang_pred, r.score) for r in langid.digest(odd).collect()}
    assert none[1] == none[2] == none[3] == ("und", 0.0)
    assert langid.digest(docs.limit(0)).count() == 0


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    times, covered, seen, dup = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality_counts(spark, request, name):
    df = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in decision_list.digest(df, spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows_of(df)), key=repr)


def test_decision_list_learns():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = decision_list.learn(x, bad)
    hit = np.logical_or.reduce([decision_list._covers(r, x) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_string_kernel():
    def slow(s, t, n=toxicity.LENGTH, d=toxicity.DECAY):
        from itertools import combinations
        weight = collections.defaultdict(lambda: [0.0, 0.0])
        for k, w in enumerate((s, t)):
            for c in combinations(range(len(w)), n):
                weight["".join(w[i] for i in c)][k] += d ** (c[-1] - c[0] + 1)
        return sum(a * b for a, b in weight.values())

    for s in ("^idiot$", "^i.d.i.o.t$", "^stupid$", "^theidea$", "aaaaaa"):
        for t in ("^idio", "aaaa", "stupi"):
            chars = np.frombuffer(s.encode("utf-32-le"), np.uint32).reshape(1, -1)
            assert toxicity.kernel(chars, t)[0] == pytest.approx(slow(s, t), rel=1e-4)


def test_toxicity(spark, odd):
    words = [f"kind{i}" for i in range(60)]
    rows = [(i, " ".join(words[(i * 7 + j) % 60] for j in range(30)) + (" horribleword" if i % 4 == 0 else "")) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.digest(made, labels).collect()}
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(400))
    model = toxicity.train(made, labels)
    assert model.score(toxicity.Describer(model.landmarks)(["kind1 horr-ible-word", "h o r r i b l e", "kind2 kind3"])).round().tolist() == [1, 1, 0]
    assert {r.score for r in toxicity.digest(odd, labels.limit(0)).collect()} == {0.0}


def test_curriculum(spark, odd):
    out = curriculum.assign(odd, carry=("doc_id", "text")).collect()
    assert len(out) == len(ODD) and all(0 <= t <= 1 for r in out for t in r.times) and all(len(r.times) <= 3 for r in out)
    assert [r.position for r in curriculum.mixed(odd, carry=("doc_id",)).collect()] == sorted(t for r in out for t in r.times)
    assert curriculum.digest(odd.limit(0)).count() == 0


def test_curriculum_counts_the_mix(spark, odd, monkeypatch):
    """The query's words come from the copies of the mix in their order of time."""
    tables, keep = {}, curriculum.stored
    monkeypatch.setattr(curriculum, "stored", lambda df, label: tables.setdefault(label, keep(df, label)))
    out = curriculum.digest(odd.union(odd)).collect()
    mix = [(r.position, r.row) for r in tables["mix"].collect()]
    assert len(out) == 2 * len(ODD) and mix == sorted(mix) and len(mix) > 0
    assert sum(r.taken for r in out) == sum(r.size for r in tables["mix"].collect())


def test_tool_links(spark):
    schema = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
    calls = spark.createDataFrame([(1, "a", 0, "f", '{"x": 1}', ["b"]), (1, "b", 2, "f", '{"x":"1"}', []), (1, "b", 3, "f", "{}", None), (1, None, 4, "f", None, None),
                                   (2, "c", 0, "g", "{}", ["d"]), (2, "d", 1, "f", "no", ["c"])], schema)
    results = spark.createDataFrame([(1, "a", 1, "r1"), (1, "a", 5, "r2"), (3, "z", 0, "r3")], "conv_id long, call_id string, turn long, content string")
    out = {(r.conv_id, r.call_id, r.turn): r for r in tool_chat.link(calls, results, {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()}
    assert out[1, "a", 0].status == "linked" and out[1, "a", 0].position == 1 and out[1, "a", 0].valid
    assert out[1, "a", 0].json == '{"call":{"arguments":{"x":1},"name":"f"},"id":"a","result":"r1","status":"linked"}'
    assert out[1, "b", 2].status == "unanswered" and out[1, "b", 2].position == 0 and out[1, "b", 2].errors == ["arguments.x: not integer"]
    assert out[1, "b", 3].status == "repeated" and out[1, None, 4].status == "repeated" and out[1, "a", 5].status == out[3, "z", 0].status == "orphan"
    assert out[2, "c", 0].status == out[2, "d", 1].status == "circular" and out[2, "c", 0].errors == ["name: unknown tool"]
    assert len(out) == 8


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((30, 16))
    x = np.concatenate([c + rng.standard_normal((12, 16)) * s for c, s in zip(centre, rng.random(30) * 0.3, strict=True)])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(900, x[0].tolist(), 0), (901, None, 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, x[0].tolist(), None), (905, [], 0)]
    monkeypatch.setattr(subspace_join, "CHUNK", 20)
    out = {r.vec_id: (r.n_links, r.component_id) for r in subspace_join.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and np.isfinite(v).all() and np.any(v)]
    for i, v, y in good:
        assert out[i][0] == sum(j != i and w == y and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.98 for j, u, w in good)
    assert all(out[i] == (0, i) for i in (901, 902, 903, 904, 905)) and out[900][1] == out[0][1] == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = ",".join(df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"select {cols} from ({queries.ORACLES[name]})").fetchall()))


def chain(rows):
    """The five stages in plain Python on (doc_id, text, lang, source) rows; returns (doc_id, lang, source, n_tokens, ids digest)."""
    import zlib
    from tokenizers import Tokenizer
    # 1: naive Bayes over hashed n-grams, learnt from documents that are not held out
    def grams(t):
        ids, first = langid.gram_ids([t])
        return collections.Counter(ids[: len(t)].ravel().tolist())
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang, _ in rows:
        if t is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 3 == 1):
            counts[lang].update(grams(t))
            sizes[lang] += 1
    kept = []
    for r in rows:
        if not r[1] or not any(c.isalpha() for c in r[1]) or not counts:
            continue
        score = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * langid.BUCKETS
            score[lang] = np.log(sizes[lang] / sum(sizes.values())) + sum(n * np.log((c[g] + 0.5) / total) for g, n in grams(r[1]).items())
        best = max(score.values())
        if 1 / sum(np.exp(v - best) for v in score.values()) >= 0.5:
            kept.append(r)
    # 2: near duplicates by all pairs; the smallest id of a group stays, rows of equal id and text once
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t, *_ in kept]
    codes = {w: n for n, w in enumerate({w for ws in words for w in ws})}
    seqs = [np.array([codes[w] for w in ws], np.uint32) for ws in words]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if root[a] != root[b] and (words[a] == words[b] or order_minhash.similar(seqs[a], seqs[b])):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    first = {}
    for n, r in enumerate(kept):
        first[root[n]] = min(first.get(root[n], (True, 0, n)), (r[0] is None, r[0] or 0, n))
    kept = [kept[n] for *_, n in first.values()]
    # 3: passages of 35 words that stand elsewhere too
    units = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t, *_ in kept]
    seen = collections.Counter(tuple(u[p : p + 35]) for u in units for p in range(len(u) - 34))
    cleaned = []
    for (i, t, lang, source), u in zip(kept, units, strict=True):
        gone = set()
        for p in range(len(u) - 34):
            if seen[tuple(u[p : p + 35])] > 1:
                gone |= set(range(p, p + 35))
        cleaned.append((i, " ".join(w for n, w in enumerate(u) if n not in gone) if gone else t, lang, source))
    # 4: the mix, by the SQL of the operator
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", cleaned)
    copies = dict(con.execute(f"select doc_id, taken from ({curriculum.SQL.replace('(size * (', '(1 * (')})").fetchall())  # also of texts left without words
    mixed = [r for r in cleaned for _ in range(copies[r[0]])]
    # 5: the library's tokens
    lib = Tokenizer.from_file(queries.vocabulary_path())
    out = []
    for i, t, lang, source in mixed:
        ids = lib.encode(t, add_special_tokens=False).ids
        out.append((i, lang, source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out, key=repr), [len(x) for x in (rows, kept, mixed)]


def test_pipeline_equals_plain_chain(spark, docs, tmp_path):
    """Whole ``run`` on a fixture with null, empty, repeated, NUL and 2 MiB texts, near copies, shared passages and clashing columns."""
    pytest.importorskip("tokenizers")
    import corpus_pipeline as c
    some = [(r.doc_id, r.text, r.lang, r.source) for r in docs.orderBy("doc_id").limit(60).collect()]
    base = some[0][1].split()
    extra = [(1001, None, "en", "a"), (1002, "", "en", "a"), (1003, "½ ² 12", "en", "a"), (1004, "the\0 quick \0brown fox and the dog", "en", "a"), some[5],
             (1005, " ".join(f"the word{i} and" for i in range(150_000)), "en", None), (1006, " ".join(base[:-1] + ["changed"]), some[0][2], some[0][3]),
             (1007, "see this now: " + SHARED + " and so it ends", "en", "a"), (1008, "the other one " + SHARED + " was here before", "en", "b"), (None, "no name but the words of a text", "en", "a")]
    rows = some + extra
    names = "doc_id long, text string, lang string, source string, n_chars int, score double, lang_pred string, _h long, removed int, kept string, id string, n_words int, size int, target int, times int, position int, source_size int, _row int"
    df = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 1, 2, "y", "z", 3, 4, 5, 6, 7, 8, 9) for r in rows], names).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want, sizes = chain(rows)
    got = sorted(((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256) for r in c.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and sizes[0] > sizes[1] > 20
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline as c
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []


def test_letters_of_language_id(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½ ²", "① Ⅷ", "12", "a½", "日"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.digest(df).collect()}
    assert [got[i] for i in range(5)] == ["und", "und", "und", "en", "en"]


def test_pipeline(spark, odd):
    import corpus_pipeline as c
    docs = odd
    first = c.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and 1 not in [r.doc_id for r in first.collect()]
    second = c.STAGES[1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in second.collect() if r.doc_id in (4, 5)) == [4]
    third = {r.doc_id: r.text for r in c.STAGES[2][1](spark, docs, SF).collect()}
    assert third[6] == "start end" and third[8] == "q" * 3000
    assert c.run(spark, SF).count() > 100


def test_segments_hold_little_scratch_memory():
    """A batch of 5 MB of text is cut in parts, so what a task holds at a time stays under 50 MB; parts of other sizes give the same segments."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from tracework.llm import repeats

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 800, 1000)) for _ in range(1100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1100), pa.int64()), pa.array(range(1100), pa.int64()), pa.array(texts)], names=["_id", "_h", "_text"])
    docs = SimpleNamespace(schema={"_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, mapInArrow=lambda f, schema: f)
    cut = repeats.segments(docs, repeats.Spec("word", 35, 8))
    want = [r for b in cut([batch.slice(0, 20)]) for r in b.to_pylist()]  # also fills the tables of powers
    tracemalloc.start()
    n, first = 0, []
    for b in cut([batch]):
        n += len(b)
        first = first or b.slice(0, len(want)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and first == want and n > len(want)
