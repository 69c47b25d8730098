"""Sources: the driver's Parquet tables and the landed CSV / JSON / HTML feeds."""

from rankmart.sources.tables import TABLES, table  # noqa: F401
