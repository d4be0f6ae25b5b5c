"""Run registered queries against their oracle SQL and report differences."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from docweir.catalog.inputs import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"{'rows-only':10s} {name:28s} {len(rows):7d} rows {took:6.2f}s", True
    t = time.time()
    cols, want = oracle_rows(sql, sf_dir)
    otook = time.time() - t
    if sorted(df.columns) != sorted(cols):
        return f"COLUMNS    {name}: spark {sorted(df.columns)} oracle {sorted(cols)}", False
    order = sorted(cols)
    si = [df.columns.index(c) for c in order]
    oi = [cols.index(c) for c in order]
    a = Counter(tuple(_norm(r[i]) for i in si) for r in rows)
    b = Counter(tuple(_norm(r[i]) for i in oi) for r in want)
    if a == b:
        return f"ok         {name:28s} {len(rows):7d} rows {took:6.2f}s oracle {otook:5.2f}s", True
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return (
        f"DIFF       {name}: spark {len(rows)} oracle {len(want)} {order}\n"
        f"   only spark  {str(extra)[:900]}\n   only oracle {str(missing)[:900]}"
    ), False


def main(names, sf_dir="/root/testdata/sf0.001"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from docweir.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names or queries:
        try:
            line, good = compare(spark, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            line, good = f"ERROR      {n}: {str(e)[:1200]}", False
        bad += not good
        print(line, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.001"
    if args and args[0].startswith("sf"):
        sf = "/root/testdata/" + args.pop(0)
    main(args, sf)
