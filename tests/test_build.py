"""The whole refresh job on a tiny landing folder."""

import json
import os

from rankmart.plans.build import build_all
from rankmart.sources.sinks import read_mart


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_build_all(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    rows = ["model,model_group,benchmark,performance,date"]
    for i, g in enumerate(["GPT-5", "Claude 4", "Gemini 3 Pro"]):
        for b in ["MATH level 5", "WeirdML", "ARC-AGI-2", "GPQA diamond", "SimpleBench"]:
            rows.append(f"{g},{g},{b},{0.3 + 0.1 * i},2025-05-0{i + 1}")
    write(f"{land}/benchmarks/b.csv", "\n".join(rows) + "\n")
    write(f"{land}/notable/n.csv", 'Model,Organization,Publication date,Training compute (FLOP),Parameters\n'
                                   'GPT-4,OpenAI,2023-03-14,2.1e25,1e12\nX,Nobody,2023-01-01,1,1\n')
    write(f"{land}/ml_hardware/h.csv", "Manufacturer\nNVIDIA\nNVIDIA\nHuawei\n")
    write(f"{land}/gpu_clusters/c.csv",
          'Name,Owner,Country,Status,Chip type (primary),latitude,longitude,H100 equivalents,Power Capacity (MW)\n'
          'A,O,France,Existing,H100,48,2,1000,10\nAnonymized,O2,China,,,30,110,NaN,\nAnonymized,O2,China,,,30,110,,\n')
    write(f"{land}/catalog/m.json", json.dumps({"data": [
        {"id": "openai/gpt-4o-2025-05-01", "name": "GPT-4o", "created": 1746057600, "context_length": 128000,
         "pricing": {"prompt": "0.0000025", "completion": "0.00001"},
         "architecture": {"input_modalities": ["text", "image"], "output_modalities": ["text"]}}]}))
    write(f"{land}/hub_top/t.json", json.dumps([{"id": "Qwen/q", "downloads": 100, "createdAt": "2025-05-01"}]))
    write(f"{land}/hub_trending/t.json", json.dumps([{"id": "a/b", "downloads": 1, "likes": 2, "createdAt": "2025-05-30"}]))
    write(f"{land}/hub_modality/t.json", json.dumps([{"id": "hexgrad/k", "downloads": 5, "pipeline_tag": "text-to-speech"}]))
    write(f"{land}/leaderboard/index.html", '<script id="leaderboard-data">[{"name": "bash-only", "results": '
                                            '[{"name": "Claude agent", "resolved": 70.5}]}]</script>')
    write(f"{land}/pypi/openai.json", json.dumps({"package": "openai", "data": {"last_week": 10, "last_month": 40}}))
    out = os.path.join(tmp_dir, "marts")
    written = build_all(spark, land, out, "2025-06-01 00:00:00")
    assert len(written) == 28
    lb = read_mart(spark, written["leaderboard"]).orderBy("rank").collect()
    assert [r["model_group"] for r in lb] == ["Gemini 3 Pro", "Claude 4", "GPT-5"]
    tl = {r["model"] for r in read_mart(spark, written["timeline"]).collect()}
    assert tl == {"GPT-4", "GPT-5", "Claude 4", "Gemini 3 Pro"}
    assert read_mart(spark, written["coding"]).first()["org"] == "Anthropic"
    assert read_mart(spark, written["gpu_stats"]).first()["total_clusters"] == 3
    assert read_mart(spark, written["pricing"]).first()["prompt_1m"] == 2.5
    assert read_mart(spark, written["coding_insight"]).first()["insight"] == (
        "Claude agent leads at 70.5% of real GitHub issues resolved. 0 of the top 1 systems use open-source components.")
    assert read_mart(spark, written["modality_insight"]).first()["insight"] == (
        "Across 7 AI modalities, Hexgrad's k leads Voice with 5 downloads.")


def test_build_cli(spark, tmp_dir, capsys):
    from rankmart.plans.build import main
    land = os.path.join(tmp_dir, "landing")
    write(f"{land}/ml_hardware/h.csv", "Manufacturer\nNVIDIA\nAMD\nAMD\n")
    main(["--landing", land, "--out", os.path.join(tmp_dir, "out"), "--as-of", "2025-06-01 00:00:00"])
    out = json.loads(capsys.readouterr().out)
    assert set(out) == {"chips", "chips_insight"}
    assert read_mart(spark, out["chips"]).orderBy("rank").first()["manufacturer"] == "AMD"


def test_build_rerun_is_idempotent(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    write(f"{land}/ml_hardware/h.csv", "Manufacturer\nNVIDIA\nAMD\nAMD\n")
    out = os.path.join(tmp_dir, "out")
    first = build_all(spark, land, out, "2025-06-01 00:00:00")
    build_all(spark, land, out, "2025-06-01 00:00:00")           # rerun of the same snapshot
    build_all(spark, land, out, "2025-06-02 00:00:00")           # next snapshot
    assert spark.read.parquet(first["chips"]).count() == 4       # 2 makers x 2 snapshots, no duplicates
    assert read_mart(spark, first["chips"]).count() == 2


def test_build_uses_newest_snapshot_only(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")

    def catalog(path, ids, mtime):
        write(path, json.dumps({"data": [{"id": i, "name": i, "created": 1748000000, "context_length": 1000,
                                          "pricing": {"prompt": "0.000001", "completion": "0.000001"}} for i in ids]}))
        os.utime(path, (mtime, mtime))

    catalog(f"{land}/catalog/2025-05-01.json", ["openai/old-model"], 1746057600)
    catalog(f"{land}/catalog/2025-06-01.json", ["openai/new-model", "google/gemini-x"], 1748736000)
    write(f"{land}/pypi/a.json", json.dumps({"package": "openai", "data": {"last_week": 1}}))
    os.utime(f"{land}/pypi/a.json", (1746057600, 1746057600))
    write(f"{land}/pypi/b.json", json.dumps({"package": "openai", "data": {"last_week": 7}}))
    write(f"{land}/pypi/c.json", json.dumps({"package": "anthropic", "data": {"last_week": 3}}))
    out = build_all(spark, land, os.path.join(tmp_dir, "out"), "2025-06-02 00:00:00")
    names = sorted(r["name"] for r in read_mart(spark, out["pricing"]).collect())
    assert names == ["google/gemini-x", "openai/new-model"]
    pk = {r["package"]: r["last_week"] for r in read_mart(spark, out["packages"]).collect()}
    assert pk == {"openai": 7, "anthropic": 3}


def test_every_file_of_the_newest_snapshot_stays(spark, tmp_dir):
    from rankmart.sources import feeds as S
    land = os.path.join(tmp_dir, "bench")
    rows = spark.range(1000).selectExpr("'m' || id AS model", "'g' || (id % 7) AS model_group", "'MATH level 5' AS benchmark",
                                        "id / 1000.0 AS performance", "'2025-05-01' AS date")
    rows.repartition(4).write.option("header", True).csv(land)
    assert S.newest_snapshot(S.read_csv(spark, land, S.BENCH_SCORES, with_file=True)).count() == 1000
    # a newer complete landing wins, and the older one never mixes in
    rows.limit(300).repartition(3).write.mode("append").option("header", True).csv(land)
    assert S.newest_snapshot(S.read_csv(spark, land, S.BENCH_SCORES, with_file=True)).count() == 300
    stamped = os.path.join(tmp_dir, "stamped")
    for stamp, n in (("20250102", 5), ("20250101", 9)):  # the older stamp lands last
        for part in range(2):
            write(f"{stamped}/snapshot={stamp}/{part}.csv", "Manufacturer\n" + "NVIDIA\n" * n)
    got = S.newest_snapshot(S.read_csv(spark, stamped, S.ML_HARDWARE, with_file=True))
    assert got.count() == 10 and got.columns[0] == "Manufacturer"


def test_every_tag_response_gives_its_champion(spark, tmp_dir):
    from rankmart import fixed
    land = os.path.join(tmp_dir, "landing")
    tags = [t for t, _ in fixed.HF_MODALITY_TAGS]
    for i, tag in enumerate(tags):
        write(f"{land}/hub_modality/{tag}.json", json.dumps([{"id": f"org/m{i}", "downloads": i, "pipeline_tag": tag},
                                                             {"id": f"org/n{i}", "downloads": i + 1, "pipeline_tag": tag}]))
    written = build_all(spark, land, os.path.join(tmp_dir, "marts"), "2025-06-01 00:00:00")
    got = {r["label"]: r["model_name"] for r in read_mart(spark, written["modality_champions"]).collect()}
    assert got == {label: f"n{i}" for i, (_, label) in enumerate(fixed.HF_MODALITY_TAGS)}


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    import pytest
    from rankmart.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
