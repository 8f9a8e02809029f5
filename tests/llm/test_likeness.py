"""Common-subsequence bound and joint kernel of the toxicity operator against plain versions."""
import numpy as np

from tracework.llm import toxicity


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
    return row[-1]


def test_common_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for mark in ("abcab", "aabaa", "abcdefghabcd"):
        rows = rng.integers(0, 10, (200, 12))
        got = toxicity.common(rows, np.array([ord(c) - 96 for c in mark]))
        assert got.tolist() == [lcs("".join(chr(96 + x) for x in r), mark) for r in rows]


def test_joint_kernels_equal_single_ones():
    words, marks = ["^idiot$", "^idi0t$", "^i_d_i_o_t$", "", "^" + "idiot" * 9 + "$", "^table$"], ["^idio", "^ab$", "tabl"]
    values = toxicity.likeness(words, marks)
    for k, m in enumerate(marks):
        own = toxicity.kernel(np.frombuffer(m.encode("utf-32-le"), np.uint32).reshape(1, -1), m)[0]
        best = np.zeros(len(words), np.float32)
        for at, chars in toxicity.codes(words):
            np.maximum.at(best, at, toxicity.kernel(chars, m) / own)
        assert np.array_equal(values[:, k], best)
    assert values[0, 0] >= 1 and values[3].max() == 0
