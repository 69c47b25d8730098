"""The pipeline against its stages done by brute force on a small corpus."""

import numpy as np
import pytest

import corpus_pipeline
from rankmart.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    common, rare = ["the", "of", "and", "to", "in"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    prose = lambda n=150: [str(rng.choice(common if rng.random() < 0.4 else rare)) for _ in range(n)]
    item = " ".join(prose(20))
    texts = [" ".join(prose()) for _ in range(50)]
    texts[10] = texts[3]                                             # a copy
    texts[11] = texts[4] + " tail"                                   # a near copy
    texts[12] = texts[12] + " " + item + " " + texts[13]             # a leak
    texts[14] = " ".join(x + "***" for x in texts[14].split())       # junk
    texts[15] = "short"
    texts[16] = texts[16] + " someone.else@mail.example.com"
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_and_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{14, 15}, {10, 11}, {12}, set()]
    left = set(range(50))
    for (name, stage), lost in zip(corpus_pipeline.STAGES, gone):
        out = stage(spark, docs, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        left -= lost
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(left), name
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert "someone.else" not in kept[16]["text"] and "@" in kept[16]["text"] and kept[16]["n_chars"] == len(kept[16]["text"])
    run = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in run} == left and all(r["length"] <= 4096 for r in run)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1)) and set(ORACLE) <= set(QUERIES)


def test_quality_twin(spark, folder):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    res = con.execute(ORACLE["op9_quality_divergence"])
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in QUERIES["op9_quality_divergence"](spark, folder).collect()) == want
