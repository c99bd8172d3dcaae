"""Run registered queries and their SQL side by side.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from allelegate.plans.fixtures import BASE  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads=8")
    con.execute("set timezone='UTC'")
    for table in BASE:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def multiset(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got), took, "no sql"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), took, f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    a, b = multiset(got, df.columns), multiset(want, names)
    if a != b:
        return len(got), took, (
            f"DIFFER spark {len(got)} duck {len(want)}\n  cols {sorted(names)}\n"
            f"  spark only {list((a - b).items())[:2]}\n  duck only  {list((b - a).items())[:2]}"
        )
    types = {d[0]: str(d[1]) for d in res.description}
    odd = [(c, t) for c, t in types.items() if t in ("HUGEINT", "NULL")]
    return len(got), took, "ok" if not odd else f"ok BUT types {odd}"


def main() -> int:
    import __spark_entry__ as entry
    from allelegate.plans.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    wanted = sys.argv[2:]
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            n, took, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            n, took, note = -1, 0.0, f"ERROR {str(exc)[:1500]}"
        bad += not note.startswith(("ok", "no sql"))
        print(f"{name:28s} {n:8d} rows {took:7.2f}s  {note}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
