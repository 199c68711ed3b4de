"""Check registered queries against DuckDB: ``python tests/run_oracle.py [sf_dir] [key ...]``."""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry
from compare import check, connect
from isolark.session import local_session

if __name__ == "__main__":
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for key, fn in entry.queries().items():
        if args and not any(a == key or (a.endswith("*") and key.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            if key in oracles:
                problem, n = check(fn(spark, sf_dir), con, oracles[key])
            else:
                problem, n = None, len(fn(spark, sf_dir).collect())
        except Exception as exc:  # report every query, then fail
            problem, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        print(f"{'ok ' if problem is None else 'BAD'} {key:28s} {n:7d} rows {time.time() - start:6.2f}s {'' if key in oracles else '(rows only)'} {problem or ''}", flush=True)
        bad += [key] if problem else []
    print("failed:", bad)
    sys.exit(bool(bad))
