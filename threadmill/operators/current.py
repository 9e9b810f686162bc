"""Latest row per key: the read side of every append-only table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``order`` (nulls lowest).

    Combined map-side, so a key that holds a large share of all rows costs one
    partial row per input task.  Ties in ``order`` go to the greatest of the
    kept columns, in their order, so that the result doesn't depend on row
    order.  Null keys form a group; an empty table gives an empty one.  Kept
    columns must be orderable (no maps).
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c not in keys])
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)] + [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    top = df.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.k{i}").alias(c) for i, c in enumerate(keep)))
