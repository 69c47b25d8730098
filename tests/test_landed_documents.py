"""Documents of drifting shape as variants (S5, S9, X24) and the quarantine scan."""

import json
import os

from pyspark.sql import functions as F

from rankmart.plans import params as P
from rankmart.plans.documents import land_packages
from rankmart.sources.quarantine import counts, scan
from rankmart.sources.variant import category_results, embedded_json, field, items, named_or_first, unknown_fields

PATTERN = r'(?s)id="data"[^>]*>\s*(.*?)\s*</script>'


def page(doc):
    return f'<html>\n<script type="x" id="data">\n  {doc if isinstance(doc, str) else json.dumps(doc)}\n</script></html>'


def test_category_results(spark):
    cats = [{"name": "full", "results": [{"name": "x", "resolved": 1}]},
            {"name": "bash-only", "results": [{"name": "p", "resolved": "70.5", "cost": {"usd": 3}}, {"resolved": None, "tags": []}, "odd", {"name": 5, "resolved": "n/a"}]}]
    rows = [(1, page(cats)), (2, page(cats[:1])), (3, page([])), (4, page('[{"name": "bash-only", "resul')), (5, "<html>none</html>"), (6, None),
            (7, page({"name": "bash-only"})), (8, page([{"results": [{"name": "first"}]}])), (9, page([{"name": "bash-only", "results": {"a": 1}}]))]
    df = spark.createDataFrame(rows, "id int, html string")
    got = category_results(df, "html", PATTERN, "bash-only", {"name": "string", "resolved": "double"}, keep=["id"])
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[2])) == [
        (1, "bash-only", 0, "p", 70.5, ["cost"]), (1, "bash-only", 1, None, None, ["tags"]), (1, "bash-only", 2, None, None, []),
        (1, "bash-only", 3, "5", None, []), (2, "full", 0, "x", 1.0, []), (8, None, 0, "first", None, [])]


def test_fields(spark):
    df = spark.sql("""SELECT parse_json('{"a": {"b": 7}, "t": "12", "f": true, "n": null, "l": [1, "2"]}') AS v""")
    v = F.col("v")
    out = df.select(field(v, "a.b", "int"), field(v, "t", "bigint"), field(v, "t", "double"), field(v, "f", "boolean"), field(v, "n", "string"),
                    field(v, "a", "int"), field(v, "zz", "double"), F.size(items(v, "$.l")), items(v, "$.a").isNull(), unknown_fields(v, ["a", "t"])).first()
    assert tuple(out) == (7, 12, 12.0, True, None, None, None, 2, True, ["f", "l", "n"])
    none = spark.sql("SELECT cast(null AS variant) AS v").select(named_or_first(items(F.col("v")), "x").isNull(), unknown_fields(F.col("v"), []))
    assert tuple(none.first()) == (True, [])
    assert spark.range(1).select(embedded_json(F.lit("x"), PATTERN).isNull()).first()[0]


GOOD = {"package": "p", "data": {"n": 3, "total": 1.5}}
FILES = {"a.json": json.dumps(GOOD), "b.json": json.dumps(GOOD, indent=1) + "\n\n", "cut.json": json.dumps(GOOD)[:20], "list-cut.json": "[1, 2", "empty.json": "",
         "blank.json": " \n\t", "html.json": "<html>429</html>", "list.json": "[1]", "text.json": '"x"', "none.json": '{"package": "p"}',
         "null.json": '{"package": "p", "data": {"n": null, "total": 1}}', "type.json": '{"package": "p", "data": {"n": "many", "total": 1}}',
         "as-text.json": '{"package": "p", "data": {"n": "4", "total": "2"}}', "more.json": json.dumps(GOOD | {"new": [1]})}
REQUIRED = {"package": "string", "data.n": "bigint", "data.total": "double"}


def test_quarantine(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in/day=1")
    for name, text in FILES.items():
        with open(f"{tmp_dir}/in/day=1/{name}", "w") as f:
            f.write(text)
    good, bad = scan(spark, f"{tmp_dir}/in", REQUIRED, f"{tmp_dir}/out")
    name = F.substring_index("file", "/", -1)
    assert sorted(r[0] for r in good.select(name).collect()) == ["a.json", "as-text.json", "b.json", "more.json"]
    assert good.select(F.sum(field(F.col("doc"), "data.n", "bigint"))).first()[0] == 13 and "day" in good.columns
    assert {r[0]: r[1] for r in bad.select(name, "reason").collect()} == {
        "cut.json": "truncated", "list-cut.json": "truncated", "empty.json": "empty", "blank.json": "empty", "html.json": "not json",
        "list.json": "not an object", "text.json": "not an object", "none.json": "missing data.n", "null.json": "missing data.n", "type.json": "wrong type data.n"}
    assert {r["head"] for r in bad.filter("reason = 'not json'").collect()} == {"<html>429</html>"}
    files = {r["reason"]: r["files"] for r in counts(spark, f"{tmp_dir}/out").collect()}
    assert files["good"] == 4 and sum(files.values()) == len(FILES)


def test_one_scan_feeds_both_sides(spark, tmp_dir):
    """Both sides read the judged table, each its own folder, and not the files again."""
    os.makedirs(f"{tmp_dir}/in")
    for n in ("a.json", "empty.json"):
        with open(f"{tmp_dir}/in/{n}", "w") as f:
            f.write(FILES[n])
    good, bad = scan(spark, f"{tmp_dir}/in", REQUIRED, f"{tmp_dir}/out")
    os.remove(f"{tmp_dir}/in/a.json")
    assert good.count() == 1 and bad.count() == 1
    for side, folder in ((good, "status=good"), (bad, "status=quarantined")):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "status" in plan.split("PartitionFilters:", 1)[1].split("]")[0]


def events(spark, n: int, path: str) -> None:
    rows = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "concat('t', id % 2) AS event_type",
                                     "CAST(id AS DOUBLE) AS value", "'{}' AS props")
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")


def test_packages_land_by_many_tasks(spark, tmp_dir):
    """One task does not write all small files, and a folder holds a file per type and part."""
    events(spark, 14 * P.QU_EVENTS, f"{tmp_dir}/sf")
    land_packages(spark, f"{tmp_dir}/sf", f"{tmp_dir}/landed")
    names = [n for t in ("t0", "t1") for n in os.listdir(f"{tmp_dir}/landed/event_type={t}") if n.startswith("part-")]
    assert len(names) == 28 and len({n.split("-")[1] for n in names}) > 4


def test_files_are_opened_by_one_scan(spark, tmp_dir, monkeypatch):
    """The empty files come from the listing and the written table: they are found with the files themselves gone."""
    os.makedirs(f"{tmp_dir}/in/day=1")
    for name, text in FILES.items():
        with open(f"{tmp_dir}/in/day=1/{name}", "w") as f:
            f.write(text)
    made = type(spark).createDataFrame

    def gone(self, *args, **kw):  # the listing is made a table once the scan has run
        for name in FILES:
            os.remove(f"{tmp_dir}/in/day=1/{name}")
        return made(self, *args, **kw)

    monkeypatch.setattr(type(spark), "createDataFrame", gone)
    good, bad = scan(spark, f"{tmp_dir}/in", REQUIRED, f"{tmp_dir}/out")
    monkeypatch.undo()
    assert good.count() == 4 and good.count() + bad.count() == len(FILES)
    assert {(r["file"].rsplit("/", 1)[1], r["day"], r["bytes"], r["head"]) for r in bad.filter("reason = 'empty'").collect()} == {
        ("empty.json", 1, 0, ""), ("blank.json", 1, 3, " \n\t")}
