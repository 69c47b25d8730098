"""String helpers: id splitting, family keys and ordered-rule classification."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def org_of(c, fallback=None) -> Column:
    """Text before the first "/" (X1).

    ``fallback`` is what an id without "/" maps to: ``None`` keeps the whole
    id; otherwise a literal ("community", "—", "") or a Column.
    """
    c = _c(c)
    other = c if fallback is None else _lit(fallback)
    return F.when(c.contains("/"), F.substring_index(c, "/", 1)).otherwise(other)


def short_name(c) -> Column:
    """Everything after the first "/", or the whole id without one."""
    c = _c(c)
    return F.when(c.contains("/"), F.regexp_extract(c, r"(?s)^[^/]*/(.*)$", 1)).otherwise(c)


def base_name(c) -> Column:
    """Text after the last "/" (X3)."""
    return F.substring_index(_c(c), "/", -1)


def family_key_dated(c) -> Column:
    """Strip a trailing -YYYY-MM-DD or -MM-DD, then a trailing -YYYY-MM."""
    c = _c(c)
    once = F.regexp_replace(c, r"(-\d{4})?-\d{2}-\d{2}$", "")
    return F.regexp_replace(once, r"-\d{4}-\d{2}$", "")


def family_key_tagged(c, tags: Sequence[str]) -> Column:
    """org/base with a trailing -YYYY-MM[-DD] stripped, then a :tag.

    The date is stripped before the tag, so "b-2024-08:free" keeps its date.
    An id without "/" has org "".
    """
    c = _c(c)
    base = base_name(c)
    no_date = F.regexp_replace(base, r"-\d{4}-\d{2}(-\d{2})?$", "")
    no_tag = F.regexp_replace(no_date, ":(" + "|".join(tags) + ")$", "")
    org = org_of(c, "")
    return F.concat(org, F.lit("/"), no_tag)


def family_key_suffix(c, patterns: Iterable[str]) -> Column:
    """Apply each pattern once, in order, removing what it matches."""
    out = _c(c)
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return out


def classify_first(c, rules, mode: str = "contains", default=None) -> Column:
    """First matching rule wins.

    ``rules`` is an ordered list of ``(patterns, label)``; ``patterns`` is a
    string or a list of strings. ``mode``: ``contains`` (case-sensitive
    substring), ``contains_ci`` (case-insensitive substring) or ``prefix``.
    """
    c = _c(c)
    probe = F.lower(c) if mode == "contains_ci" else c
    expr = None
    for patterns, label in rules:
        if isinstance(patterns, str):
            patterns = [patterns]
        cond = None
        for p in patterns:
            if mode == "prefix":
                hit = probe.startswith(p)
            elif mode == "contains_ci":
                hit = probe.contains(p.lower())
            elif mode == "contains":
                hit = probe.contains(p)
            else:
                raise ValueError(f"unknown mode {mode!r}")
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, _lit(label)) if expr is None else expr.when(cond, _lit(label))
    if expr is None:
        return _lit(default)
    return expr.otherwise(_lit(default))


def normalise_name(c) -> Column:
    """Lower case with surrounding whitespace removed (X10, like str.strip().lower())."""
    return F.lower(F.regexp_replace(_c(c), r"^\s+|\s+$", ""))


def first_line(c) -> Column:
    """Text up to the first newline."""
    return F.substring_index(_c(c), "\n", 1)
