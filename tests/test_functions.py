"""Golden cases for the column helpers (FIXTURES.md edge rows)."""

import datetime as dt
import math

import duckdb
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import (
    age_days, base_name, classify_first, decay_weight, epoch_utc_label, family_key_dated, family_key_suffix,
    family_key_tagged, hash_uniform, iso_prefix_date, normalise_name, org_of, rank_label, short_name,
    short_number, strict_date, to_double, truncate_label,
)
from rankmart.operators import map_lookup


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


IDS = ["a/b-2024-11-20", "a/b-05-06", "a/b-2024-08", "a/b-2024-08:free", "a/b:extended", "a/b-0314"]


def test_family_key_dated(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "v string")
    got = [r[0] for r in df.select(family_key_dated("v")).collect()]
    assert got == ["a/b", "a/b", "a/b", "a/b-2024-08:free", "a/b:extended", "a/b-0314"]


def test_family_key_tagged(spark):
    df = spark.createDataFrame([(i,) for i in IDS + ["solo-2024-01"]], "v string")
    got = [r[0] for r in df.select(family_key_tagged("v", fixed.CONTEXT_VARIANT_TAGS)).collect()]
    assert got == ["a/b", "a/b-05-06", "a/b", "a/b-2024-08", "a/b", "a/b-0314", "/solo"]


def test_family_key_suffix_order(spark):
    names = ["GPT-5 Pro", "Gemini 3 Flash", "Model (preview)", "X-Codex-Max", "Y Image Gen", "Z Fast Pro"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r[0] for r in df.select(family_key_suffix("v", fixed.FAMILY_STRIP_PATTERNS)).collect()]
    # each pattern applies once, in order: "Z Fast Pro" loses Pro but Fast was tried earlier
    assert got == ["GPT-5", "Gemini 3", "Model", "X", "Y", "Z Fast"]


def test_org_fallbacks(spark):
    df = spark.createDataFrame([("org/x/y",), ("noslash",)], "v string")
    rows = df.select(org_of("v"), org_of("v", "community"), org_of("v", "—"), org_of("v", ""),
                     short_name("v"), base_name("v")).collect()
    assert tuple(rows[0]) == ("org", "org", "org", "org", "x/y", "y")
    assert tuple(rows[1]) == ("noslash", "community", "—", "", "noslash", "noslash")


def test_classify_first_order_and_modes(spark):
    rules = fixed.SWEBENCH_ORG_PATTERNS
    df = spark.createDataFrame([("Claude via GPT",), ("gemini-pro",), ("unknown",), (None,)], "v string")
    got = [r[0] for r in df.select(classify_first("v", rules, "contains_ci", "Other")).collect()]
    assert got == ["Anthropic", "Google", "Other", "Other"]
    df2 = spark.createDataFrame([("GPT-4o",), ("o3-mini",), ("Claude 3",), ("xGrok",)], "v string")
    got2 = [r[0] for r in df2.select(classify_first("v", fixed.BENCHMARK_ORG_PREFIXES, "prefix")).collect()]
    assert got2 == ["OpenAI", "OpenAI", "Anthropic", None]
    tiers = [r[0] for r in spark.createDataFrame([("Claude Opus 4",), ("Gemini Flash",), ("GPT-5",)], "v string")
             .select(classify_first("v", fixed.TIER_KEYWORDS, "contains", 2)).collect()]
    assert tiers == [4, 1, 2]


def test_normalise_and_labels(spark):
    assert one(spark, normalise_name(F.col("v")), "  Foo Bar\t") == "foo bar"
    assert one(spark, truncate_label(F.col("v"), 22), "x" * 22) == "x" * 22
    assert one(spark, truncate_label(F.col("v"), 22), "y" * 23) == "y" * 21 + "…"
    assert one(spark, rank_label(F.lit(3), F.col("v")), "m") == "#3  m"


def test_numbers_to_double(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("abc",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(to_double("v")).collect()] == [1.5, None, None, None, None]


def test_short_number(spark):
    df = spark.createDataFrame([(1234567,), (4321,), (999,), (2500,), (None,)], "v long")
    assert [r[0] for r in df.select(short_number("v", "?")).collect()] == ["1M", "4K", "999", "3K", "?"]


def test_dates(spark):
    df = spark.createDataFrame([("2025-01-03T10:00:00Z",), ("",), ("2025-1-3",), ("bad",), (None,)], "v string")
    got = [r[0] for r in df.select(iso_prefix_date("v")).collect()]
    assert got == [dt.date(2025, 1, 3), None, None, None, None]
    assert one(spark, strict_date(F.col("v")), "2025-01") is None
    # future date: unclamped negative, clamped 0; missing -> default
    assert one(spark, age_days(F.col("v").cast("date"), "2025-01-01"), "2025-01-11") == -10
    assert one(spark, age_days(F.col("v").cast("date"), "2025-01-01", clamp=True), "2025-01-11") == 0
    assert one(spark, age_days(F.col("v").cast("date"), "2025-01-01", clamp=True, missing=365), None) == 365
    assert one(spark, epoch_utc_label(F.col("v")), 0, "v long") == "1970-01-01 00:00 UTC"


def test_decay_constant(spark):
    w = one(spark, decay_weight(F.col("v")), 60, "v int")
    assert math.isclose(w, math.exp(-0.693), rel_tol=1e-12)


def test_hash_uniform_matches_sql(spark):
    u = one(spark, hash_uniform(F.col("v"), 42, "lat"), "abc")
    d = duckdb.sql("select ('0x'||substr(md5('abc:42:lat'),1,8))::BIGINT/4294967296.0").fetchall()[0][0]
    assert u == d and 0 <= u < 1


def test_map_lookup_defaults(spark):
    df = spark.createDataFrame([("NVIDIA",), ("Nobody",), (None,)], "v string")
    got = [r[0] for r in df.select(map_lookup("v", fixed.CHIP_MANUFACTURER_COUNTRY, "Other")).collect()]
    assert got == ["US", "Other", "Other"]
    got2 = [r[0] for r in df.select(map_lookup("v", {"NVIDIA": "N"}, F.col("v"))).collect()]
    assert got2 == ["N", "Nobody", None]


def test_sizing():
    from rankmart.session import sizing
    conf = sizing(100 * 2 ** 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(sizing(10 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_more_helpers(spark):
    from rankmart.functions import first_line, short_tokens, trunc_to_long
    df = spark.createDataFrame([(2_000_000,), (131_072,), (999,), (1_048_576,)], "v long")
    assert [r[0] for r in df.select(short_tokens("v")).collect()] == ["2.0M", "131K", "0K", "1.0M"]
    assert one(spark, first_line(F.col("v")), "title\nbody\nmore") == "title"
    assert one(spark, first_line(F.col("v")), "single") == "single"
    assert one(spark, strict_date(F.col("v"), "dd/MM/yyyy"), "03/01/2025") == dt.date(2025, 1, 3)
    assert one(spark, strict_date(F.col("v"), "dd/MM/yyyy"), "2025-01-03") is None
    # rounding to 6 digits first: 12345.9999999996 is 12346, not 12345
    assert one(spark, trunc_to_long(F.col("v")), 12345.9999999996, "v double") == 12346
    assert one(spark, trunc_to_long(F.col("v")), 3.99, "v double") == 3
    assert one(spark, to_double(F.col("v")), 7, "v int") == 7.0
