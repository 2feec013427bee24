"""Run registered queries and compare them with their check SQL in DuckDB.

    python tools/check_queries.py [--sf DIR] [names ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.plans import load_all  # noqa: E402
from fleetlens.session import session  # noqa: E402
from fleetlens.sources.tables import BASE  # noqa: E402


def rows_of(names, rows):
    """Column-sorted, value-sorted rows."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    registry = load_all()
    spark = session("check", f"local[{os.cpu_count()}]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    chosen = [n for n in registry if not args.names or n in args.names or any(n.startswith(a.rstrip("*")) for a in args.names if a.endswith("*"))]
    for name in chosen:
        q = registry[name]
        started = time.time()
        try:
            got = q.run(spark, args.sf).toArrow()
            took = time.time() - started
            if q.sql is None:
                print(f"rows  {name:32} {got.num_rows:8} rows {took:6.2f}s")
                continue
            cur = con.execute(q.check_sql())
            want = cur.fetchall()
            names = [d[0] for d in cur.description]
            a = rows_of(got.column_names, list(zip(*[got.column(n).to_pylist() for n in got.column_names])))
            b = rows_of(names, want)
            if a == b and got.num_rows:
                print(f"ok    {name:32} {got.num_rows:8} rows {took:6.2f}s")
            else:
                bad.append(name)
                print(f"DIFF  {name:32} {got.num_rows} vs {len(want)} rows, columns {a[0]} vs {b[0]}")
                sa, sb = set(map(repr, a[1])), set(map(repr, b[1]))
                print("   spark only:", *list(sorted(sa - sb))[:3], sep="\n      ")
                print("   check only:", *list(sorted(sb - sa))[:3], sep="\n      ")
        except Exception as e:
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(chosen) - len(bad)} of {len(chosen)} fine", "bad:" if bad else "", *bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
