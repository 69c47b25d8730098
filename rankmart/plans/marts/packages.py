"""M12 package downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart import fixed
from rankmart.operators import map_lookup


# ---------------------------------------------------------------------- M12

def package_downloads(packages: DataFrame) -> DataFrame:
    rows = packages.select(
        "package", map_lookup("package", fixed.PYPI_DISPLAY_NAMES, F.col("package")).alias("display_name"),
        F.coalesce("last_week", F.lit(0)).alias("last_week"), F.coalesce("last_month", F.lit(0)).alias("last_month"),
        map_lookup("package", fixed.PYPI_COMPANY_MAP, fixed.OTHER).alias("company"))
    return rows.orderBy(F.col("last_week").desc(), F.col("package").asc())
