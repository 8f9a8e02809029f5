"""Block-wise peaks equal a direct search on the whole signal."""
import numpy as np
import pandas as pd
import pytest

from tracework.operators import peaks as pk


def direct(x, distance, drop):
    tops = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1]]
    kept = []
    for p in sorted(tops, key=lambda i: (x[i], i), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def floor(side):
        low = np.inf
        for v in side:
            if v > x[p]:
                break
            low = min(low, v)
        return low

    out = []
    for p in sorted(kept):
        if x[p] - max(floor(x[:p][::-1]), floor(x[p + 1:])) >= drop:
            out.append(p)
    return out


@pytest.mark.parametrize("block", [16, 50, 10_000])
def test_find_peaks(spark, block):
    rng = np.random.default_rng(4)
    t = np.arange(400)
    groups = {"noise": rng.normal(size=400), "wave": np.sin(t / 9.0) + 0.2 * rng.normal(size=400), "ramp": t / 50 + 0.3 * rng.normal(size=400)}
    pdf = pd.concat([pd.DataFrame({"k": k, "i": t, "v": v}) for k, v in groups.items()])
    got = pk.find_peaks(spark.createDataFrame(pdf), ["k"], "i", "v", distance=7, prominence_std=0.8, block=block).toPandas()
    for k, x in groups.items():
        assert sorted(got.loc[got["k"] == k, "i"]) == direct(x, 7, 0.8 * x.std())
