"""M4 release timeline: two sources, flagship filter, dot sizes, insight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import classify_first, clip_lower, strict_date, to_double
from rankmart.operators import append_missing, flagship_cut, impute_median, map_lookup, minmax_scale


# ----------------------------------------------------------------------- M4

def benchmark_models(bench: DataFrame, rules=fixed.BENCHMARK_ORG_PREFIXES) -> DataFrame:
    """model_group, latest date, org by name prefix; unknown org or date dropped."""
    g = bench.filter(F.col("model_group").isNotNull()).groupBy("model_group").agg(F.max("date").alias("date"))
    return (g.withColumn("org", classify_first("model_group", rules, "prefix"))
             .filter(F.col("org").isNotNull())
             .withColumn("date", strict_date(F.substring("date", 1, 10)))
             .filter(F.col("date").isNotNull()))


def timeline(notable: DataFrame, bench: DataFrame | None = None, org_map: dict = fixed.TIMELINE_ORG_MAP) -> DataFrame:
    """model, org, date, compute_flop, parameters, has_compute (notable + missing benchmark models).

    When ``notable`` carries ``src_order`` (``read_csv(with_order=True)``), the output keeps
    the rows' order as ``src_order``: notable rows in file order, then the added benchmark
    models by name (the order ties are resolved in by the flagship filter).
    """
    order = [F.col("src_order")] if "src_order" in notable.columns else []
    a = (notable.select(
            F.col("Model").alias("model"),
            map_lookup("Organization", org_map).alias("org"),
            strict_date(F.substring("Publication date", 1, 10)).alias("date"),
            to_double("Training compute (FLOP)").alias("compute_flop"),
            to_double("Parameters").alias("parameters"), *order)
         .filter(F.col("date") >= F.lit(fixed.TIMELINE_MIN_DATE).cast("date"))
         .filter(F.col("org").isNotNull())
         .withColumn("has_compute", F.col("compute_flop").isNotNull()))
    if bench is None:
        return a
    b_order = ([F.struct(F.lit(1).alias("part"), F.col("model_group").alias("file"), F.lit(0).cast("long").alias("block"),
                         F.lit(0).cast("long").alias("row")).alias("src_order")] if order else [])
    b = benchmark_models(bench).select(F.col("model_group").alias("model"), "org", "date",
                                       F.lit(None).cast("double").alias("compute_flop"),
                                       F.lit(None).cast("double").alias("parameters"),
                                       F.lit(False).alias("has_compute"), *b_order)
    return append_missing(a, b, "model", "model")


def flagship(rows: DataFrame, as_of, months: int = fixed.FLAGSHIP_MONTHS) -> DataFrame:
    """Recent rows, highest tier then newest per family of stripped names (see ``flagship_cut``).

    Remaining ties go to the row first in source order when ``src_order`` is present (the
    source sorts stably), else to the model name.
    """
    ties = ([F.col("src_order").asc(), F.col("model").asc()] if "src_order" in rows.columns
            else [F.col("model").asc()])
    kept = flagship_cut(rows, as_of, months, fixed.FAMILY_STRIP_PATTERNS, fixed.TIER_KEYWORDS, fixed.DEFAULT_TIER,
                        tiebreak=ties)
    return kept.drop("_family", "_tier")


def timeline_sizes(tl: DataFrame) -> DataFrame:
    """Rows with compute and their dot size: per org clip 1, median fill, log10, 6-22 (else 12)."""
    c = tl.filter("has_compute").withColumn("_p", clip_lower("parameters", 1.0))
    c = impute_median(c, "_p", "org", "_pf").withColumn("_lg", F.log10("_pf"))
    return minmax_scale(c, "_lg", 6.0, 22.0, 12.0, "size", by="org").drop("_p", "_pf", "_lg")


def timeline_insight(tl: DataFrame, as_of) -> DataFrame:
    oc = (tl.filter(F.col("org").isNotNull()).groupBy("org").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("org").alias("o"))).alias("m")))
    recent = flagship(tl.filter(~F.col("has_compute")), as_of).agg(F.count(F.lit(1)).alias("num_recent"))
    big = F.min(F.when(F.col("has_compute"), F.struct((-F.col("compute_flop")).alias("c"), F.col("model").alias("m"),
                                                      F.col("org").alias("o"))))
    one = tl.agg(big.alias("b"), F.min(F.when(F.col("has_compute"), F.col("compute_flop"))).alias("mn"))
    out = one.crossJoin(oc).crossJoin(recent).select(
        F.col("m.o").alias("most_active"), (-F.col("m.k")).alias("most_active_count"), "num_recent",
        F.col("b.m").alias("biggest_model"), F.col("b.o").alias("biggest_org"), (-F.col("b.c")).alias("biggest_compute"),
        (F.col("mn") * 0.15).alias("rug_y"))
    with_compute = F.format_string(
        fixed.INSIGHT_TIMELINE, "most_active", "most_active_count", "biggest_model", "biggest_org",
        "biggest_compute")
    recent_txt = F.when(F.col("num_recent") > 0, F.format_string(fixed.INSIGHT_TIMELINE_RECENT,
                                                                 "num_recent")).otherwise(F.lit(""))
    no_compute = F.format_string(fixed.INSIGHT_TIMELINE_NO_COMPUTE, "most_active", "most_active_count")
    return out.withColumn("insight", F.when(F.col("biggest_model").isNotNull(), F.concat(with_compute, recent_txt))
                                      .otherwise(no_compute))
