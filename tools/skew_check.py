"""Correctness under skew: derive a skewed copy of the driver tables, then compare every query
with its DuckDB twin on it.

Usage: python tools/skew_check.py [sf_dir]
Writes the copy into a new scratch folder (never the input folder):
  events    user 0 holds half of all rows
  orders    customer 0 holds half of all rows
  lineitem  supplier 0 and part 0 take half of all rows
  documents one text copied 500 times
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

import duckdb

PLAIN = ["region", "nation", "customer", "supplier", "part", "embeddings", "pages", "benchmark", "labels",
         "conversations"]


def build(src: str, out: str) -> None:
    con = duckdb.connect()
    for t in PLAIN:
        con.execute(f"COPY (SELECT * FROM read_parquet('{src}/{t}.parquet')) TO '{out}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT * FROM read_parquet('{src}/events.parquet') UNION ALL
      SELECT event_id + 1000000000, ts, 0, event_type, value, props FROM read_parquet('{src}/events.parquet'))
      TO '{out}/events.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * FROM read_parquet('{src}/orders.parquet') UNION ALL
      SELECT o_orderkey + 1000000000, 0, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
      FROM read_parquet('{src}/orders.parquet')) TO '{out}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * FROM read_parquet('{src}/lineitem.parquet') UNION ALL
      SELECT l_orderkey + 1000000000, 0, 0, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
             l_returnflag, l_linestatus, l_shipdate
      FROM read_parquet('{src}/lineitem.parquet')) TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * FROM read_parquet('{src}/documents.parquet') UNION ALL
      SELECT 1000000 + g, d.text, 'en', 'src1', d.n_chars
      FROM range(500) t(g), (SELECT text, n_chars FROM read_parquet('{src}/documents.parquet') ORDER BY doc_id LIMIT 1) d)
      TO '{out}/documents.parquet' (FORMAT parquet)""")


def main():
    src = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01").rstrip("/")
    out = tempfile.mkdtemp(prefix="rankmart-skew-")
    build(src, out)
    print(f"skewed copy of {src} in {out}", flush=True)
    here = os.path.dirname(os.path.abspath(__file__))
    sys.exit(subprocess.call([sys.executable, os.path.join(here, "compare.py"), out]))


if __name__ == "__main__":
    main()
