"""Every query with a check is compared with DuckDB; every other one must return rows."""
import math
from pathlib import Path

import duckdb
import pytest

from conftest import SF
from tracework.plans import load_all
from tracework.plans.registry import ORACLES, QUERIES

load_all()
SLOW = {n for n in QUERIES if n.startswith(("ml_", "ev_robust", "ev_abl", "str_", "snk_model", "ffd_feature_row"))} - set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
