"""Capability matrix from modality arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmart.operators.dedup import top_n


def modality_count(inputs: str, outputs: str):
    """Number of input plus output modalities; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    return F.size(F.coalesce(F.col(inputs), empty)) + F.size(F.coalesce(F.col(outputs), empty))


def capability_counts(df: DataFrame, org: str, inputs: str, outputs: str,
                      spec: Sequence[tuple], n: int, tiebreak: DataFrame | None = None) -> DataFrame:
    """Per org: number of families and, per capability, families that have it.

    ``spec`` rows are (column name, "input"|"output", modality). Top ``n``
    orgs by family count; ties by ``tiebreak`` (an (org, first_pos) table:
    first appearance wins) and then by org. One partial aggregate of
    len(spec) + 1 conditional counts.
    """
    arrays = {"input": inputs, "output": outputs}
    caps = [F.sum(F.when(F.array_contains(F.col(arrays[side]), val), 1).otherwise(0)).cast("long").alias(name)
            for name, side, val in spec]
    agg = df.groupBy(org).agg(F.count(F.lit(1)).alias("total_models"), *caps)
    order = [F.col("total_models").desc()]
    if tiebreak is not None:
        agg = agg.join(tiebreak, org, "left")
        order.append(F.col("first_pos").asc_nulls_last())
    out = top_n(agg, order + [F.col(org).asc()], n)
    return out.drop("first_pos") if tiebreak is not None else out
