"""Catalog marts: M2 context sizes, M3 price map, M5 capability matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import family_key_dated, family_key_tagged, org_of, short_tokens, to_double
from rankmart.operators import bucketize, bucket_counts, capability_counts, keep_first, log_minmax, map_lookup
from rankmart.operators.capability import modality_count
from rankmart.operators.dedup import first_by_aggregate


# ----------------------------------------------------------------------- M2

def context_families(catalog: DataFrame, exclude=fixed.CONTEXT_EXCLUDE_IDS,
                     tags=fixed.CONTEXT_VARIANT_TAGS) -> DataFrame:
    """Largest context per family (first seen wins ties) with the family's first position."""
    rows = (catalog.withColumn("ctx", F.coalesce("context_length", F.lit(0)))
                   .filter(~F.col("id").isin(list(exclude)) & (F.col("ctx") > 0))
                   .withColumn("family_key", family_key_tagged(F.coalesce("id", F.lit("")), tags))
                   .withColumn("org", org_of(F.coalesce("id", F.lit("")), ""))
                   .withColumn("name", F.coalesce("name", "id")))
    return first_by_aggregate(rows, "family_key", [-F.col("ctx"), F.col("src_pos")],
                              ["id", "name", "ctx", "org"], extra=[F.min("src_pos").alias("first_pos")])


def context_buckets(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """bucket, count, examples for the six size buckets, empty ones included."""
    fam = context_families(catalog)
    return bucket_counts(spark, fam, "ctx", "name", fixed.CONTEXT_BUCKETS, F.col("first_pos").asc(),
                         examples=fixed.BUCKET_EXAMPLES, none_text=fixed.NO_EXAMPLES)


def context_insight(catalog: DataFrame) -> DataFrame:
    """Unique families, the largest one, and the sweet-spot / over-1M bucket counts."""
    fam = context_families(catalog)
    top = F.min(F.struct((-F.col("ctx")).alias("c"), F.col("first_pos").alias("p"),
                         F.col("name").alias("n"), F.col("id").alias("i")))
    labelled = fam.withColumn("_b", bucketize("ctx", fixed.CONTEXT_BUCKETS))
    sweet = [i for i, (lab, _, _) in enumerate(fixed.CONTEXT_BUCKETS, 1) if lab == "32–128K"][0]
    big = len(fixed.CONTEXT_BUCKETS)
    one = labelled.agg(F.count(F.lit(1)).alias("total_unique"), top.alias("t"),
                       F.count_if(F.col("_b") == sweet).alias("sweet_spot"),
                       F.count_if(F.col("_b") == big).alias("over_1m"))
    one = one.select("total_unique", "sweet_spot", "over_1m", F.col("t.i").alias("max_id"),
                     F.col("t.n").alias("max_name"), (-F.col("t.c")).alias("max_ctx"))
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_CONTEXT, "total_unique", "sweet_spot", "over_1m", "max_name", short_tokens("max_ctx")))


# ----------------------------------------------------------------------- M3

def pricing(catalog: DataFrame, as_of, orgs=fixed.TOP_ORGS) -> DataFrame:
    """Newest model per family among the listed orgs, per-1M prices, outliers and old models out."""
    as_of_epoch = F.unix_seconds(F.lit(str(as_of)).cast("timestamp"))
    p = to_double(F.coalesce(F.nullif(F.col("pricing.prompt"), F.lit("")), F.lit("0")))
    c = to_double(F.coalesce(F.nullif(F.col("pricing.completion"), F.lit("")), F.lit("0")))
    rows = (catalog.withColumn("org", F.split("id", "/").getItem(0))
                   .filter(F.col("org").isin(list(orgs)))
                   .withColumn("p_raw", p).withColumn("c_raw", c)
                   .filter((F.col("p_raw") > 0) & (F.col("c_raw") > 0))
                   .withColumn("prompt_1m", F.col("p_raw") * 1e6)
                   .withColumn("completion_1m", F.col("c_raw") * 1e6)
                   .filter((F.col("prompt_1m") <= fixed.PRICE_CAP_PER_1M) & (F.col("completion_1m") <= fixed.PRICE_CAP_PER_1M))
                   .withColumn("created", F.coalesce("created", F.lit(0)))
                   .filter(F.col("created") >= as_of_epoch - fixed.PRICE_MAX_AGE_SECONDS)
                   .withColumn("family", family_key_dated("id")))
    kept = keep_first(rows, "family", [F.col("created").desc(), F.col("id").asc()])
    out = kept.select(F.coalesce("name", "id").alias("name"), "org", F.col("org").alias("org_display"),
                      F.round("prompt_1m", 3).alias("prompt_1m"), F.round("completion_1m", 3).alias("completion_1m"),
                      F.coalesce("context_length", F.lit(0)).alias("context_length"))
    return log_minmax(out, "context_length", 5.0, 28.0, 16.5, "dot_size")


def pricing_insight(priced: DataFrame) -> DataFrame:
    """Model count and the cheapest model by prompt + completion price (ties: name)."""
    tot = F.col("prompt_1m") + F.col("completion_1m")
    m = F.min(F.struct(tot.alias("t"), F.col("name").alias("n"), F.col("prompt_1m").alias("p"),
                       F.col("completion_1m").alias("c")))
    one = priced.agg(F.count(F.lit(1)).alias("n_models"), m.alias("m")).select(
        "n_models", F.col("m.n").alias("cheapest"), F.col("m.t").alias("cheapest_total"),
        F.col("m.p").alias("cheapest_prompt"), F.col("m.c").alias("cheapest_completion"))
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_PRICING,
        "n_models", "cheapest", F.round("cheapest_prompt", 2), F.round("cheapest_completion", 2)))


# ----------------------------------------------------------------------- M5

def capabilities(catalog: DataFrame, top_n_: int = fixed.CAPABILITY_TOP_N) -> DataFrame:
    """Per org: unique families and how many have each capability (most capable variant per family)."""
    rows = (catalog.withColumn("inputs", F.coalesce("architecture.input_modalities", F.array().cast("array<string>")))
                   .withColumn("outputs", F.coalesce("architecture.output_modalities", F.array().cast("array<string>")))
                   .withColumn("family", family_key_dated("id"))
                   .withColumn("n_mod", modality_count("inputs", "outputs")))
    kept = keep_first(rows, "family", [F.col("n_mod").desc(), F.col("src_pos").asc()])
    kept = kept.withColumn("org", F.split("id", "/").getItem(0))
    # Orgs tied on family count keep the order in which the org first appears.
    first = rows.groupBy(F.split("id", "/").getItem(0).alias("org")).agg(F.min("src_pos").alias("first_pos"))
    caps = capability_counts(kept, "org", "inputs", "outputs", fixed.CAPABILITY_SPEC, top_n_, tiebreak=first)
    return caps.withColumn("display_name", map_lookup("org", fixed.CAPABILITY_ORG_NAMES, F.col("org")))
