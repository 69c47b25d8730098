"""The skewed copy used by tools/skew_check.py really is skewed, and whole."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import skew_check  # noqa: E402


def test_skew_copy(tmp_dir):
    src = "/root/testdata/sf0.001"
    skew_check.build(src, tmp_dir)
    con = duckdb.connect()

    def one(sql):
        return con.execute(sql).fetchone()

    n_ev, n_src = one(f"SELECT (SELECT count(*) FROM '{tmp_dir}/events.parquet'), "
                      f"(SELECT count(*) FROM '{src}/events.parquet')")
    assert n_ev == 2 * n_src
    hot = one(f"SELECT count(*) FILTER (WHERE user_id = 0) * 1.0 / count(*) FROM '{tmp_dir}/events.parquet'")[0]
    assert hot >= 0.5
    hot_cust = one(f"SELECT count(*) FILTER (WHERE o_custkey = 0) * 1.0 / count(*) FROM '{tmp_dir}/orders.parquet'")[0]
    assert hot_cust >= 0.5
    dup = one(f"SELECT max(c) FROM (SELECT count(*) c FROM '{tmp_dir}/documents.parquet' GROUP BY text)")[0]
    assert dup >= 500
    for t in skew_check.PLAIN:
        assert os.path.exists(f"{tmp_dir}/{t}.parquet")
