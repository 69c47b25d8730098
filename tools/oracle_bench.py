"""Time the DuckDB twin of every registered query (single-process yardstick).

Usage: python tools/oracle_bench.py [sf_dir]   -> one JSON line, median of 3 after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from rankmart.plans import ORACLE  # noqa: E402
from rankmart.sources.tables import TABLES  # noqa: E402


def main():
    sf = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1").rstrip("/")
    con = duckdb.connect()
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    times = {}
    for name, sql in ORACLE.items():
        con.execute(sql).fetchall()
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "duckdb_total_query_time", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
