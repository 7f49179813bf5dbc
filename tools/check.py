"""Run registered queries and compare them with their SQL twins in DuckDB.

    python tools/check.py [--dir DIR] [name or module prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from larkspan.registry import Tables, load_all  # noqa: E402
from larkspan.session import build_session  # noqa: E402

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_integer_ratio"):
        f = float(v)
        return "NULL" if math.isnan(f) else f"{f:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"create view {n} as select * from '{args.dir}/{n}.parquet'")
    bad = []
    for name, q in load_all().items():
        module = q.run.__module__.rsplit(".", 1)[-1]
        if args.names and not any(name == a or module == a for a in args.names):
            continue
        t0 = time.time()
        try:
            df = q.run(Tables(spark, args.dir))
            if args.explain:
                df.explain("formatted")
            if args.show:
                df.show(8, 80)
            sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
            continue
        t1 = time.time()
        if q.sql is None:
            print(f"rows  {name}: {len(sr)} rows {t1 - t0:.2f}s (no sql)")
            continue
        try:
            rel = con.execute(q.sql)
            dc = [d[0] for d in rel.description]
            types = {d[0]: str(d[1]) for d in rel.description}
            dc, dr = rows_of(dc, rel.fetchall())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQLERR {name}: {str(e)[:700]}")
            continue
        odd = [
            f"{c}:{s}/{types[c]}"
            for c, s in ((f.name, f.dataType.simpleString()) for f in df.schema)
            if c in types and not same_type(s, types[c])
        ]
        note = f" TYPES {odd}" if odd else ""
        if sc != dc:
            bad.append(name)
            print(f"COLS  {name}: {sc} vs {dc}")
        elif sr != dr:
            bad.append(name)
            a, b = set(sr) - set(dr), set(dr) - set(sr)
            print(f"DIFF  {name}: spark {len(sr)} duck {len(dr)} cols {sc}{note}")
            for r in sorted(a)[:3]:
                print("   spark", str(r)[:400])
            for r in sorted(b)[:3]:
                print("   duck ", str(r)[:400])
        else:
            print(f"ok    {name}: {len(sr)} rows spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s{note}")
            if odd:
                bad.append(name)
    print("BAD:", bad)


def same_type(s: str, d: str) -> bool:
    d = d.upper()
    table = {
        "string": ("VARCHAR", "STRING"),
        "bigint": ("BIGINT", "NUMBER"),
        "int": ("INTEGER", "NUMBER"),
        "double": ("DOUBLE", "NUMBER"),
        "boolean": ("BOOLEAN", "BOOL"),
        "timestamp_ntz": ("TIMESTAMP", "DATETIME"),
        "date": ("DATE",),
    }
    return d in table.get(s, (d,))


if __name__ == "__main__":
    main()
