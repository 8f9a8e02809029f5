"""Compare registered queries with their SQL on one scale directory.

usage: check_oracles.py [--sf DIR] [--range N] [name-prefix ...]
"""
import argparse
import decimal
import importlib.util
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

from tracework.session import ROWS_PER_RANGE, build_session  # noqa: E402

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]",
         "array<double>": "DOUBLE[]", "array<int>": "INTEGER[]"}


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist() if hasattr(v, "tolist") else v
        if isinstance(v, list):
            return tuple(norm(x) for x in v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if isinstance(v, decimal.Decimal):
        return "DEC" + str(v)
    return v


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--range", default=None)
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false"}
    spark = build_session("check", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    if a.range:
        spark.conf.set(ROWS_PER_RANGE, a.range)
    con = duckdb.connect()
    for p in sorted(Path(a.sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad, slow = [], []
    for name, fn in qs.items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, a.sf)
            rows = df.collect()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}")
            continue
        dt = time.time() - t0
        if dt > 4:
            slow.append((name, round(dt, 1)))
        if name not in sqls:
            print(f"rows {name} n={len(rows)} {dt:.1f}s")
            continue
        t1 = time.time()
        try:
            cur = con.execute(sqls[name])
            names = [d[0] for d in cur.description]
            orows = cur.fetchall()
            types = {r[0]: r[1] for r in con.execute("describe " + sqls[name]).fetchall()}
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: SQL {str(e)[:500]}")
            continue
        ot = time.time() - t1
        cols = sorted(df.columns)
        msg = []
        if cols != sorted(names):
            msg.append(f"columns {cols} vs {sorted(names)}")
        else:
            for c, t in df.dtypes:
                if TYPES.get(t, t) != types[c]:
                    msg.append(f"type {c}: {t} vs {types[c]}")
            key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
            s = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=key)
            ix = [names.index(c) for c in cols]
            o = sorted((tuple(norm(r[i]) for i in ix) for r in orows), key=key)
            if s != o:
                ss, oo = set(s), set(o)
                only_s = sorted(ss - oo, key=key)
                only_o = sorted(oo - ss, key=key)
                msg.append(f"values differ: {len(s)} vs {len(o)} rows; {len(only_s)}/{len(only_o)} differ {cols}")
                msg += [f"   spark {x}" for x in only_s[:a.show]]
                msg += [f"   duck  {x}" for x in only_o[:a.show]]
        if not rows:
            msg.append("EMPTY result")
        if msg:
            bad.append(name)
            print(f"DIFF {name} {dt:.1f}s", *msg, sep="\n  ")
        else:
            print(f"ok   {name} n={len(rows)} {dt:.1f}s duck {ot:.1f}s", flush=True)
    print("bad:", bad)
    print("slow:", slow)


main()
