"""Date helpers; every age is measured against an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _iso_day(s: Column) -> Column:
    # The regex fixes the shape (no "2025-01", "2025-1-3" or trailing text, which a
    # lenient cast accepts); try_cast then nulls impossible days. Cheaper per row
    # than a pattern-based parse.
    return F.when(s.rlike(ISO_DAY), s.try_cast("date"))


def strict_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse with one fixed format; anything else is null."""
    s = _c(c).cast("string")
    if fmt == "yyyy-MM-dd":
        return _iso_day(s)
    return F.try_to_timestamp(s, F.lit(fmt)).cast("date")


def iso_prefix_date(c) -> Column:
    """First 10 characters of an ISO timestamp as a date, null if invalid (X11)."""
    return _iso_day(F.substring(F.coalesce(_c(c).cast("string"), F.lit("")), 1, 10))


def age_days(d, as_of, clamp: bool = False, missing=None) -> Column:
    """Whole days from ``d`` to ``as_of`` (X12); optionally clamped at 0 and defaulted."""
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    days = F.datediff(as_of_c, _c(d)).cast("long")
    if missing is not None:  # before the clamp: greatest() would turn null into 0
        days = F.coalesce(days, F.lit(missing))
    if clamp:
        days = F.when(days < 0, F.lit(0)).otherwise(days)
    return days


def epoch_utc_label(epoch_seconds) -> Column:
    """Epoch seconds to "YYYY-MM-DD HH:MM UTC" (X29)."""
    ts = F.timestamp_seconds(_c(epoch_seconds))
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
