"""Numeric helpers: safe casts, decay, log clipping and hash jitter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN becomes null so aggregates skip it like pandas does."""
    c = _c(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def to_double(c) -> Column:
    """Text or number to double; blank, unparsable and NaN become null."""
    return nan_to_null(_c(c).cast("string").try_cast("double"))


def decay_weight(age_days, k: float = 0.693, half_life_days: float = 60.0) -> Column:
    """exp(-k * age / half_life) (X13). k is 0.693 as in the source, not ln 2."""
    return F.exp(F.lit(-float(k)) * _c(age_days) / F.lit(float(half_life_days)))


def clip_lower(c, lower: float) -> Column:
    """max(x, lower) with null kept null (greatest() would return ``lower`` for null)."""
    c = _c(c).cast("double")
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(lower))))


def log_clip(c, lower: float = 1.0) -> Column:
    """log10 of the value clipped from below; null stays null."""
    return F.log10(clip_lower(c, lower))


def trunc_to_long(c, digits: int = 6) -> Column:
    """Round to ``digits`` (so partition order cannot flip the result), then truncate."""
    return F.round(_c(c), digits).cast("long")


def hash_uniform(key, seed, axis: str) -> Column:
    """Deterministic uniform [0, 1) from md5(key:seed:axis).

    Independent of partitioning (a seeded rand() is not); the same value is
    computed by md5 + hex conversion in SQL engines.
    """
    h = F.md5(F.concat_ws(":", _c(key).cast("string"), F.lit(str(seed)), F.lit(axis)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def hash_jitter(key, seed, axis: str, half_width: float) -> Column:
    """Offset uniform in [-half_width, half_width)."""
    return (hash_uniform(key, seed, axis) * 2.0 - 1.0) * F.lit(float(half_width))

