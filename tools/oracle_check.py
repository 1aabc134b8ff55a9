"""Run registered Spark queries and their DuckDB oracle SQL side by side.

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
Compares row count, column names, value kinds and an order-insensitive value multiset.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from retentia.plans.registry import load_all  # noqa: E402
from retentia.session import build_session  # noqa: E402
from retentia.sources.adapters import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return ("int", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("null",)
        return ("float", round(v, 6))
    if isinstance(v, decimal.Decimal):
        return ("dec", round(float(v), 6))
    if isinstance(v, dt.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(norm(x) for x in v))
    if isinstance(v, dict):
        return ("map", tuple(sorted((k, norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return ("row", tuple(norm(x) for x in v))
    return ("str", str(v))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[1:] if not a.startswith("/")]
    reg = load_all()
    if os.environ.get("PLAIN_SESSION") == "1":
        # What a driver might hand us: defaults everywhere except the master.
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = skipped = 0
    for name, (fn, sql) in sorted(reg.items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if sql is None:
            skipped += 1
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={scols} duck={dcols}")
        else:
            idx = [dcols.index(c) for c in scols]
            drows = [tuple(r[i] for i in idx) for r in drows]
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems:
            sn = sorted((tuple(norm(v) for v in r) for r in srows), key=repr)
            dn = sorted((tuple(norm(v) for v in r) for r in drows), key=repr)
            if sn != dn:
                diffs = [(a, b) for a, b in zip(sn, dn) if a != b][:3]
                problems.append(f"values differ e.g. {diffs}")
        if problems:
            bad += 1
            print(f"FAIL {name}: " + "; ".join(problems)[:1500])
        else:
            ok += 1
            print(f"OK   {name}: {len(srows)} rows {ts:.1f}s")
    print(f"ok={ok} bad={bad} rows-only={skipped}")


if __name__ == "__main__":
    try:
        main()
    except Exception:
        traceback.print_exc()
        sys.exit(1)
