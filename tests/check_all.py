"""Checks all or the named queries against DuckDB: ``check_all.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402

from driftline.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", {"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            if name in sql:
                rows, found = compare(spark, con, queries[name], sql[name], sf)
            else:
                rows, found = queries[name](spark, sf).count(), []
        except Exception as error:  # noqa: BLE001
            rows, found = -1, [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name:28s} rows={rows} {time.time() - start:6.2f}s "
              f"{'' if name in sql else '(rows only) '}{' | '.join(found)}", flush=True)
    print(f"{bad} failing of {len(args or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
