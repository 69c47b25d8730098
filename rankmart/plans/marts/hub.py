"""Hub marts: M8 decayed downloads, M9 trending, M10 modality champions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import age_days, iso_prefix_date, org_of, short_name, short_number
from rankmart.operators import map_lookup, top_n
from rankmart.operators.decay import decay_column, decayed_sum


def _as_of_date(as_of):
    return F.lit(str(as_of)[:10]).cast("date")


# ----------------------------------------------------------------------- M8

def downloads(hub: DataFrame, as_of, top_n_: int = fixed.DOWNLOADS_TOP_N) -> DataFrame:
    """Recency-weighted downloads per org (60-day half life), top n."""
    rows = (hub.withColumn("org", org_of(F.coalesce("id", F.lit("")), fixed.COMMUNITY_ORG))
               .filter(~F.col("org").isin(fixed.DOWNLOADS_EXCLUDED_ORGS))
               .withColumn("weight", decay_column(iso_prefix_date("createdAt"), _as_of_date(as_of),
                                                  fixed.DECAY_K, fixed.HALF_LIFE_DAYS, fixed.MISSING_AGE_DAYS))
               .withColumn("dl", F.coalesce("downloads", F.lit(0))))
    g = decayed_sum(rows, "org", "dl")
    top = top_n(g, [F.col("downloads").desc(), F.col("org").asc()], top_n_)
    return top.withColumn("display_name", map_lookup("org", fixed.ORG_DISPLAY_NAMES, F.col("org")))


def downloads_insight(top: DataFrame) -> DataFrame:
    """Leader of the shown orgs and the total over them."""
    lead = F.min(F.struct((-F.col("downloads")).alias("d"), F.col("org").alias("o"),
                          F.col("display_name").alias("n"), F.col("model_count").alias("c")))
    one = top.agg(lead.alias("l"), F.sum("downloads").alias("shown_total")).select(
        F.col("l.n").alias("leader"), (-F.col("l.d")).alias("leader_downloads"), F.col("l.c").alias("leader_models"),
        "shown_total")
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_DOWNLOADS,
        "leader", short_number("leader_downloads"), "leader_models", short_number("shown_total")))


# ----------------------------------------------------------------------- M9

def trending(hub_trending: DataFrame, as_of) -> DataFrame:
    created = F.substring(F.coalesce("createdAt", F.lit("")), 1, 10)
    return hub_trending.select(
        (F.col("src_pos") + 1).alias("rank"),
        short_name(F.coalesce("id", F.lit(""))).alias("model_name"),
        org_of(F.coalesce("id", F.lit("")), fixed.NO_ORG).alias("org"),
        F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("downloads", F.lit(0)).alias("downloads"),
        created.alias("created_date"), age_days(iso_prefix_date(created), _as_of_date(as_of)).alias("days_ago"))


def trending_insight(tr: DataFrame) -> DataFrame:
    """Leader by downloads (its rank need not be 1) and the freshest model."""
    lead = F.min(F.struct((-F.col("downloads")).alias("d"), F.col("rank").alias("r"),
                          F.col("model_name").alias("m"), F.col("org").alias("o")))
    fresh = F.min(F.when(F.col("days_ago").isNotNull(), F.struct(F.col("days_ago").alias("a"), F.col("rank").alias("r"),
                                                                 F.col("model_name").alias("m"))))
    one = tr.agg(lead.alias("l"), fresh.alias("f")).select(
        F.col("l.r").alias("leader_rank"), F.col("l.m").alias("leader"), F.col("l.o").alias("leader_org"),
        (-F.col("l.d")).alias("leader_downloads"), F.col("f.m").alias("freshest"), F.col("f.a").alias("freshest_days"))
    head = F.format_string(fixed.INSIGHT_TRENDING, "leader_rank", "leader", "leader_org",
                           short_number("leader_downloads"))
    tail = F.when(F.col("freshest").isNotNull(),
                  F.format_string(fixed.INSIGHT_TRENDING_FRESHEST, "freshest", "freshest_days")).otherwise(F.lit(""))
    return one.withColumn("insight", F.concat(head, tail))


# ---------------------------------------------------------------------- M10

def modality_champions(champions: DataFrame) -> DataFrame:
    """label, model_name, org, display_org, downloads, likes (from one champion per tag)."""
    return champions.select("label", "model_name", "org",
                            map_lookup("org", fixed.MODALITY_ORG_NAMES, F.col("org")).alias("display_org"),
                            "downloads", "likes")


def modality_insight(champions: DataFrame, n_modalities: int = len(fixed.HF_MODALITY_TAGS)) -> DataFrame:
    lead = F.min(F.struct((-F.col("downloads")).alias("d"), F.col("label").alias("l"),
                          F.col("model_name").alias("m"), F.col("display_org").alias("o")))
    one = champions.agg(lead.alias("x")).select(F.col("x.o").alias("display_org"), F.col("x.m").alias("model_name"),
                                                F.col("x.l").alias("label"), (-F.col("x.d")).alias("downloads"))
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_MODALITY, F.lit(n_modalities), "display_org",
        "model_name", "label", short_number("downloads")))
