"""The README's usage snippet runs as written (on a small landed fixture).

The README's relative paths are placeholders; Spark resolves relative paths against the JVM's
working folder, so the same calls run here on absolute ones.
"""

import json
import os

from rankmart import get_spark
from rankmart.plans import marts
from rankmart.sources import feeds


def test_readme_usage(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    os.makedirs(f"{land}/benchmarks")
    os.makedirs(f"{land}/catalog")
    with open(f"{land}/benchmarks/b.csv", "w") as f:
        f.write("model,model_group,benchmark,performance,date\n")
        for g, p in [("A", 0.9), ("B", 0.5), ("C", 0.2)]:
            for b in ["MATH level 5", "WeirdML", "ARC-AGI-2", "GPQA diamond", "SimpleBench"]:
                f.write(f"{g},{g},{b},{p},2025-05-01\n")
    with open(f"{land}/catalog/m.json", "w") as f:
        json.dump({"data": [{"id": "openai/gpt-x", "name": "X", "created": 1748000000, "context_length": 128000,
                             "pricing": {"prompt": "0.000001", "completion": "0.000002"}}]}, f)

    spark_ = get_spark()
    assert spark_ is spark  # the running session is reused
    bench = feeds.read_csv(spark_, f"{land}/benchmarks/", feeds.BENCH_SCORES)
    assert [r["model_group"] for r in marts.leaderboard_matrix(bench).orderBy("rank").collect()] == ["A", "B", "C"]
    assert marts.leaderboard_insight(bench).first()["top_model"] == "A"
    catalog = feeds.read_catalog(spark_, f"{land}/catalog/")
    assert marts.pricing(catalog, as_of="2025-06-01 00:00:00").first()["name"] == "X"
    assert marts.context_buckets(spark_, catalog).count() == 6
