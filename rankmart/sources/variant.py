"""Nested documents of drifting shape (S9, S5, X24): VARIANT instead of one fixed schema.

A fixed ``from_json`` schema turns a document null, or drops what it doesn't name, when a field changes its type, moves or
appears. A variant keeps the document as it is; each field is asked for by path and type, and answers null where a document
lacks it or holds something else there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedded_json(page: Column, pattern: str) -> Column:
    """The JSON text embedded in a page (group 1 of ``pattern``) as a variant; null without one or if it doesn't parse."""
    text = F.regexp_extract(page, pattern, 1)
    return F.try_parse_json(F.when(text != "", text))


def items(value: Column, path: str = "$") -> Column:
    """The array at ``path`` as an array of variants; null if there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def field(value: Column, name: str, kind: str) -> Column:
    """A field by type, also where the document holds it as text: null if it is missing or can't be read so."""
    direct = F.try_variant_get(value, f"$.{name}", kind)
    if kind == "string":
        return direct
    return F.coalesce(direct, F.try_variant_get(value, f"$.{name}", "string").try_cast(kind))


def named_or_first(array: Column, name: str, key: str = "name") -> Column:
    """The first element whose ``key`` is ``name``, else the first element (X24); null for an empty or missing array."""
    hit = F.get(F.filter(array, lambda x: F.coalesce(F.try_variant_get(x, f"$.{key}", "string") == name, F.lit(False))), F.lit(0))
    return F.coalesce(hit, F.get(array, F.lit(0)))


def unknown_fields(value: Column, known: Sequence[str]) -> Column:
    """Sorted names of an object's fields that aren't among ``known``; empty for none, and for what isn't an object."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known]))), F.array().cast("array<string>"))


def explode_items(df: DataFrame, array: Column, pos: str = "src_pos", item: str = "item") -> DataFrame:
    """One row per element with its position in the document (the "first seen" order); documents without elements give none."""
    return df.select("*", F.posexplode(array).alias(pos, item))


def category_results(pages: DataFrame, page: str, pattern: str, category: str, fields: dict[str, str],
                     name: str = "name", results: str = "results", keep: Sequence[str] = ()) -> DataFrame:
    """Page -> embedded JSON -> named category (else the first) -> its results with positions.

    Columns: ``keep``, category, src_pos, one per entry of ``fields`` (name: type), and ``unknown``, the names of further
    fields of the result. Pages without the block, without a category or with results of another kind give no rows.
    """
    doc = pages.select(*keep, embedded_json(F.col(page), pattern).alias("_doc")).filter(F.col("_doc").isNotNull())
    picked = doc.select(*keep, named_or_first(items(F.col("_doc")), category, name).alias("_cat")).filter(F.col("_cat").isNotNull())
    rows = explode_items(picked.select(*keep, F.try_variant_get("_cat", f"$.{name}", "string").alias("category"), items(F.col("_cat"), f"$.{results}").alias("_results")),
                         F.col("_results"), item="_item")
    return rows.select(*keep, "category", "src_pos", *[field(F.col("_item"), f, t).alias(f) for f, t in fields.items()],
                       unknown_fields(F.col("_item"), list(fields)).alias("unknown"))
