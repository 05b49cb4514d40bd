"""Run registered queries against their SQL on one scale factor and report differences.

usage: python tools/check_queries.py /root/testdata/sf0.001 [name-substring ...]
"""

from __future__ import annotations

import math
import os
import signal
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


LIMIT = int(os.environ.get("CHECK_LIMIT", "90"))


def give_up(*_):
    raise TimeoutError(f"over {LIMIT} s")


signal.signal(signal.SIGALRM, give_up)
SQL_SECONDS: list[float] = []


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sort_key(row):
    return tuple((v is not None, type(v).__name__, f"{v:.4e}" if isinstance(v, float) else str(v)) for v in row)


def kind(t: str) -> str:
    t = t.lower()
    return {"string": "varchar", "int": "integer", "tinyint": "tinyint", "timestamp_ntz": "timestamp"}.get(t, t)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str:
    began = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    theirs_rows = cur.fetchall()
    SQL_SECONDS.append(time.time() - began)
    cols = sorted(df.columns)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    bad = [(c, t, types[c]) for c, t in df.dtypes
           if kind(t) != types[c] and not t.startswith("array") and not t.startswith("struct")]
    if bad:
        return f"types {bad}"
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=sort_key)
    order = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in theirs_rows), key=sort_key)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if diff:
        return f"{len(diff)}/{len(mine)} rows differ, cols {cols}\n   mine {diff[0][0]}\n   sql  {diff[0][1]}"
    return "" if mine else "EMPTY"


def main() -> None:
    from tidemark.plans import load_all
    from tidemark.plans.registry import ORACLES, QUERIES
    from tidemark.session import build_session

    load_all()
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false",
                          spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='check-')}")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        SQL_SECONDS.clear()
        signal.alarm(LIMIT)
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                problem = "" if df.count() > 0 else "EMPTY"
        except BaseException as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        signal.alarm(0)
        took = time.time() - start - sum(SQL_SECONDS)
        tag = "ok " if not problem else "BAD"
        print(f"{tag} {name:<40} {took:6.2f}s sql {sum(SQL_SECONDS):5.2f}s {'' if name in ORACLES else '(rows only)'} {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
