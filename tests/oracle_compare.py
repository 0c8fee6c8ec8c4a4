"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if v != v:
            return "<null>"
        if v == int(v):
            return str(int(v))
        return repr(round(v, 6))
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    import __spark_entry__ as E
    from codeatlas.session import get_spark
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sqls = E.oracle_sql()
    ok = 0
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"SPARKFAIL {name}: {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"NOSQL {name} rows={len(rows)}")
            continue
        try:
            res = con.execute(sqls[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQLFAIL {name}: {str(e)[:400]}")
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        same = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
        ok += same
        print(f"{'MATCH' if same else 'DIFF '} {name:26s} rows={len(rows)}/{len(orows)} spark={ts:.1f}s"
              + ("" if sorted(cols) == sorted(ocols) else f" cols {sorted(cols)} vs {sorted(ocols)}"))
        if not same and os.environ.get("SHOW"):
            a, b = set(l1), set(l2)
            for x in sorted(a - b)[:4]:
                print("   spark only:", x[:400])
            for x in sorted(b - a)[:4]:
                print("   sql   only:", x[:400])
    print("matched", ok)


if __name__ == "__main__":
    main()
