"""Run the queries beside their SQL twins in DuckDB: ``python tools/check.py [sf_dir] [names...]``."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tastegrid.queries import ORACLES, QUERIES  # noqa: E402
from tastegrid.sources.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> list[str]:
    out = []
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} / {sorted(right.columns)}"]
    left, right = canonical(left), canonical(right)
    kinds = [(c, str(left[c].dtype), str(right[c].dtype)) for c in left.columns]
    out += [f"type of {c}: {a} / {b}" for c, a, b in kinds if a != b and "datetime" not in a]
    if len(left) != len(right):
        return [*out, f"rows {len(left)} / {len(right)}"]
    for c in left.columns:
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            i = same.idxmin()
            out.append(f"{c}: {(~same).sum()} rows, first {left[c][i]!r} / {right[c][i]!r}")
    return out


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    shared = tempfile.mkdtemp(prefix="tastegrid-")  # one machine, so a local folder is shared
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=shared,
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in args or QUERIES:
        try:
            start = time.time()
            got = QUERIES[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(got):8d} rows {spent:6.2f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(ORACLES[name]).fetchdf()
            diff = differences(got, want)
            print(
                f"{'ok   ' if not diff else 'DIFF '} {name:28s} {len(got):8d} rows {spent:6.2f}s"
                f" sql {time.time() - start:5.2f}s",
                *diff[:6],
                flush=True,
            )
            bad += bool(diff)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            bad += 1
            print(f"FAIL  {name:28s} {str(e)[:1200]}", flush=True)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print("not equal:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
