"""Display text built as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_number(c, missing: str | None = None) -> Column:
    """1234567 -> "1M", 4321 -> "4K", 999 -> "999" (X26).

    Rounds half-up (N5), where Python formatting rounds half-even.
    """
    c = _c(c)
    out = (F.when(c >= 1_000_000, F.concat(F.round(c / 1_000_000, 0).cast("long").cast("string"), F.lit("M")))
           .when(c >= 1_000, F.concat(F.round(c / 1_000, 0).cast("long").cast("string"), F.lit("K")))
           .otherwise(c.cast("long").cast("string")))
    return F.coalesce(out, F.lit(missing)) if missing is not None else out


def short_tokens(c) -> Column:
    """Token counts: one decimal in millions from 1M up, else integer thousands
    (131072 -> "131K", 999 -> "0K", 2000000 -> "2.0M")."""
    c = _c(c).cast("long")
    return (F.when(c >= 1_000_000, F.concat(F.format_string("%.1f", F.round(c / 1_000_000, 1)), F.lit("M")))
            .otherwise(F.concat(F.floor(c / 1000).cast("long").cast("string"), F.lit("K"))))


def truncate_label(c, max_len: int = 22, ellipsis: str = "…") -> Column:
    """Keep names up to ``max_len``; longer ones become max_len-1 chars + ellipsis."""
    c = _c(c)
    return F.when(F.length(c) <= max_len, c).otherwise(
        F.concat(F.substring(c, 1, max_len - 1), F.lit(ellipsis)))


def rank_label(rank, name) -> Column:
    """"#i  name" (X28)."""
    return F.concat(F.lit("#"), _c(rank).cast("string"), F.lit("  "), _c(name))
