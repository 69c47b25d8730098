"""Hardware marts: M6 maker share, M7 cluster map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.functions import to_double
from rankmart.operators import (
    jitter_flagged, log_minmax, map_lookup, region_of, share_stats, top_n, value_share,
)
from rankmart.operators.dedup import number_duplicates


# ----------------------------------------------------------------------- M6

def chip_counts(hardware: DataFrame) -> DataFrame:
    return (value_share(hardware, "Manufacturer", "manufacturer")
            .withColumn("country", map_lookup("manufacturer", fixed.CHIP_MANUFACTURER_COUNTRY, fixed.OTHER)))


def chip_dominance(hardware: DataFrame, top_n_: int = fixed.CHIP_TOP_N) -> DataFrame:
    return top_n(chip_counts(hardware), [F.col("count").desc(), F.col("manufacturer").asc()], top_n_)


def chip_insight(hardware: DataFrame) -> DataFrame:
    total = hardware.agg(F.count(F.lit(1)).alias("total"))
    st = share_stats(chip_counts(hardware), "manufacturer", "country", total).withColumnRenamed("top_key", "top_maker")
    return st.withColumn("insight", F.format_string(
        fixed.INSIGHT_CHIPS, "top_maker", "top_count", "total", F.round("top_share", 0),
        "cn_makers", "cn_count", "us_makers", "us_count"))


# ----------------------------------------------------------------------- M7

def gpu_map(clusters: DataFrame) -> DataFrame:
    """Clusters with coordinates: region, dot size, jittered anonymised points."""
    rows = (clusters.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
                    .withColumn("region", region_of("Country", fixed.GPU_REGION_MAP, fixed.EU_COUNTRIES))
                    .withColumn("h100_equiv", F.coalesce(to_double("`H100 equivalents`"), F.lit(0.0)))
                    .withColumn("power_mw", to_double("`Power Capacity (MW)`"))
                    .withColumn("anonymized", F.coalesce(F.lower("Name").contains(fixed.ANONYMIZED_MARK), F.lit(False))))
    rows = log_minmax(rows, "h100_equiv", 4.0, 24.0, 10.0, "dot_size")
    # Row key for the jitter: the row's content plus its rank among identical rows
    # (identical rows are interchangeable, so the ranks need no order and the
    # numbering is skew-safe; see number_duplicates).
    data_cols = [c for c in clusters.columns if c not in ("src_file", "src_snapshot", "fetched_at", "src_order")]
    content = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in data_cols])
    rows = number_duplicates(rows.withColumn("_content", content).drop("src_file", "src_snapshot", "fetched_at", "src_order"), "_dup")
    rows = jitter_flagged(rows, "anonymized", F.concat_ws("#", "_content", F.col("_dup").cast("string")),
                          "latitude", "longitude", fixed.JITTER_SEED, fixed.JITTER_LAT, fixed.JITTER_LON)
    return rows.select(
        F.coalesce("Name", F.lit(fixed.UNKNOWN)).alias("name"), F.coalesce("Owner", F.lit(fixed.UNKNOWN)).alias("owner"),
        F.coalesce("Country", F.lit(fixed.UNKNOWN)).alias("country"), "region",
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "h100_equiv", "power_mw",
        F.coalesce("`Chip type (primary)`", F.lit(fixed.NOT_DISCLOSED)).alias("chip_type"),
        F.coalesce("Status", F.lit(fixed.UNKNOWN)).alias("status"), "dot_size", "anonymized")


def gpu_stats(clusters: DataFrame) -> DataFrame:
    rows = clusters.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("total_clusters"),
                    F.coalesce(F.sum(to_double("`Power Capacity (MW)`")), F.lit(0.0)).alias("total_mw"))


def gpu_top_owners(clusters: DataFrame, n: int = fixed.OWNER_TOP_N) -> DataFrame:
    rows = (clusters.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("Owner").isNotNull())
                    .groupBy(F.col("Owner").alias("owner"))
                    .agg(F.sum(F.coalesce(to_double("`H100 equivalents`"), F.lit(0.0))).alias("h100_total")))
    return top_n(rows, [F.col("h100_total").desc(), F.col("owner").asc()], n)


def gpu_country_counts(clusters: DataFrame) -> DataFrame:
    rows = clusters.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return value_share(rows, "Country", "country")


def gpu_insight(clusters: DataFrame) -> DataFrame:
    """Totals, China vs US cluster counts (0 when absent), power and the top-3 owners line."""
    rows = clusters.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    k = rows.agg(F.count(F.lit(1)).alias("total_clusters"),
                 F.count_distinct("Country").alias("n_countries"),
                 F.count_if(F.col("Country") == "China").alias("cn_clusters"),
                 F.count_if(F.col("Country") == "United States of America").alias("us_clusters"),
                 F.coalesce(F.sum(to_double("`Power Capacity (MW)`")), F.lit(0.0)).alias("total_mw"))
    h = F.col("h100_total")
    part = F.when(h >= 1_000_000, F.format_string(fixed.OWNER_MILLIONS, "owner", F.round(h / 1_000_000, 1))) \
            .otherwise(F.format_string(fixed.OWNER_THOUSANDS, "owner", F.round(h / 1_000, 0)))
    owners = (gpu_top_owners(clusters, 3).withColumn("_part", part)
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_part"))),
                                            lambda x: x["_part"]), ", ").alias("top_owners")))
    one = k.crossJoin(owners)  # one row each
    return one.withColumn("insight", F.format_string(
        fixed.INSIGHT_GPU, "total_clusters", "n_countries", "cn_clusters", "us_clusters",
        F.round("total_mw", 0), "top_owners"))


def gpu_region_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("region", "anonymized").agg(F.count(F.lit(1)).alias("count"))
