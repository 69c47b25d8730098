"""Deterministic jitter of flagged points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.functions.numeric import hash_jitter


def jitter_flagged(df: DataFrame, flag: str, key, lat: str, lon: str, seed: int = 42,
                   lat_half: float = 5.0, lon_half: float = 8.0) -> DataFrame:
    """Spread flagged points that share one centroid, only if more than one is flagged.

    The offset is a hash of the row key, so it is the same under any
    partitioning or retry. The flagged count is a one-row aggregate
    (broadcast of a proven size).
    """
    n = df.agg(F.count_if(F.col(flag)).alias("_n_flagged"))
    return jitter_columns(df.crossJoin(F.broadcast(n)), flag, "_n_flagged", key, lat, lon, seed,
                          lat_half, lon_half).drop("_n_flagged")


def jitter_columns(df: DataFrame, flag: str, n_flagged: str, key, lat: str, lon: str, seed: int = 42,
                   lat_half: float = 5.0, lon_half: float = 8.0) -> DataFrame:
    """The jitter of ``jitter_flagged`` with the flagged count already on every row
    (so one global aggregate can serve several statistics)."""
    on = F.col(flag) & (F.col(n_flagged) > 1)
    return (df.withColumn(lat, F.when(on, F.col(lat) + hash_jitter(key, seed, "lat", lat_half)).otherwise(F.col(lat)))
              .withColumn(lon, F.when(on, F.col(lon) + hash_jitter(key, seed, "lon", lon_half)).otherwise(F.col(lon))))


def region_of(country, region_map: dict, eu_countries, other: str = "Other"):
    """Two-level lookup: exact map first, then the European set, else ``other``."""
    from rankmart.operators.lookup import map_lookup

    c = F.col(country) if isinstance(country, str) else country
    return F.coalesce(map_lookup(c, region_map),
                      F.when(c.isin(list(eu_countries)), F.lit("Europe")),
                      F.lit(other))
