"""Near duplicates: how many texts are compared, against all pairs; tables that the operators leave behind."""
import os
import random

import numpy as np

from tracework.llm import debruijn, order_minhash
from tracework.session import scratch, work_dir


def family(size: int, most: int) -> list[str]:
    draw = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(size):
        t = list(base)
        for at in draw.sample(range(len(base)), draw.randrange(most + 1)):
            t[at] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(t))
    return texts


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def tables(spark) -> set[str]:
    folder = work_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def plain_groups(texts: list[str]) -> list[int]:
    names: dict[str, int] = {}
    words = [np.array([names.setdefault(w, len(names)) for w in t.split()], np.uint32) for t in texts]
    group = list(range(len(texts)))

    def top(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if top(i) != top(j) and order_minhash.similar(words[i], words[j]):
                low, high = sorted((top(i), top(j)))
                group[high] = low
    return [top(i) for i in range(len(texts))]


def test_a_family_is_compared_with_few_of_its_texts(spark, monkeypatch):
    texts = family(600, 6)
    counted = []
    verified = order_minhash._verified

    def counting(pairs, words):
        counted.append(pairs.count())
        return verified(pairs, words)

    monkeypatch.setattr(order_minhash, "_verified", counting)
    found = {r["id"]: r["group_id"] for r in order_minhash.near_duplicates(rows_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == plain_groups(texts)
    assert sum(counted) < 14 * len(texts), counted


def test_wide_and_narrow_bands_align_alike(monkeypatch):
    draw = np.random.default_rng(3)
    cases = []
    for _ in range(300):
        a = draw.integers(0, 6, draw.integers(0, 30)).astype(np.uint32)
        b = np.delete(np.insert(a, draw.integers(0, len(a) + 1, 3), 9), draw.integers(0, len(a) + 3, 2))
        cases.append((a, b, int(draw.integers(0, 12))))
    narrow = [order_minhash.alignment(*c) for c in cases]
    monkeypatch.setattr(order_minhash, "BAND", 0)
    assert [order_minhash.alignment(*c) for c in cases] == narrow
    assert any(x is None for x in narrow) and any(narrow)


def test_operators_leave_no_scratch_tables(spark):
    df = rows_of(spark, family(30, 4) + ["", "one two"])
    for run, left in ((order_minhash.digest, {"llm-groups"}), (debruijn.digest, {"llm-stretches"})):
        before = tables(spark)
        out = run(df)
        new = {name.rsplit("-", 1)[0] for name in tables(spark) - before}
        assert new == left
        assert out.count() == 32


def test_scratch_keeps_tables_after_an_error(spark):
    before = tables(spark)
    try:
        with scratch():
            order_minhash.stored(spark.range(3), "a")
            raise KeyError
    except KeyError:
        pass
    assert len(tables(spark) - before) == 1
    with scratch(), scratch():
        kept = order_minhash.stored(order_minhash.stored(spark.range(3), "b"), "c", keep=True)
    assert kept.count() == 3 and len(tables(spark) - before) == 2
