"""Windows along an order that never hold a whole key.

A key with a large share of all rows would put them into one task of a plain
window.  Here rows are first dealt into chunks along the order; windows run
inside chunks, and what a chunk needs from those before it is carried over
from one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle

#: Rows that a window holds on average if all are of one key.
CHUNK_ROWS = 50_000


def same_keys(a: list[str], prefix: str = "o_") -> Column:
    test = F.lit(True)
    for k in a:
        test = test & F.col(k).eqNullSafe(F.col(prefix + k))
    return test


def numbered(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``no``: the place (from 0) of each row of a key along ``order``, whose first column is a whole number.

    Rows are numbered inside chunks of that column and chunks are counted up,
    so no window holds more than a key's rows of one chunk.
    """
    at = order[0]
    rows = rows or CHUNK_ROWS
    span = df.agg(F.min(at).alias("__lo"), F.greatest(F.lit(1), F.ceil((F.max(at) - F.min(at) + 1) / F.ceil(F.count("*") / rows))).cast("long").alias("__width"))
    m = df.join(F.broadcast(span), F.lit(True)).withColumn("__chunk", F.expr(f"({at} - __lo) div __width")).drop("__lo", "__width")  # one row
    counts = m.groupBy(*(F.col(k).alias("o_" + k) for k in keys), F.col("__chunk").alias("o___chunk")).agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.partitionBy(*("o_" + k for k in keys)).orderBy("o___chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    inner = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)) - 1
    j = m.withColumn("__inner", inner).join(offsets, same_keys([*keys, "__chunk"]))
    return j.withColumn("no", (F.col("__before") + F.col("__inner")).cast("long")).select(*df.columns, "no")


def carried(df: DataFrame, keys: list[str], mark: Column, name: str, here: bool = False, rows: int | None = None) -> DataFrame:
    """``df`` (numbered) with the ``no`` of the last row before each (``here``: or at it) for which ``mark`` holds; null if none."""
    rows = rows or CHUNK_ROWS
    m = df.withColumn("__chunk", F.expr(f"no div {rows}")).withColumn("__mark", F.when(mark, F.col("no")))
    tops = m.groupBy(*(F.col(k).alias("o_" + k) for k in keys), F.col("__chunk").alias("o___chunk")).agg(F.max("__mark").alias("__top"))
    over = Window.partitionBy(*("o_" + k for k in keys)).orderBy("o___chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__carry", F.max("__top").over(over))
    inner = F.max("__mark").over(Window.partitionBy(*keys, "__chunk").orderBy("no").rowsBetween(Window.unboundedPreceding, 0 if here else -1))
    j = m.withColumn("__in", inner).join(tops, same_keys([*keys, "__chunk"]))
    return j.withColumn(name, F.coalesce("__in", "__carry")).select(*df.columns, name)


def prefix_sums(df: DataFrame, keys: list[str], order: str, columns: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """``df`` with ``c_upto`` for each column c: its sum over the rows of the same keys up to each row along a numeric ``order``.

    ``order`` is unique within a key and not null.  Rows are dealt into ranges
    of about equal size by quantiles of the order (a bounded sketch).
    """
    d = settle(df, "sums")
    bounds = sorted(set(d.approxQuantile(order, [i / parts for i in range(1, parts)], 0.2 / parts)))
    at = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    d = d.withColumn("__range", -at if descending else at)
    along = F.desc(order) if descending else F.asc(order)
    w = Window.partitionBy(*keys, "__range").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy(*(F.col(k).alias("o_" + k) for k in keys), F.col("__range").alias("o___range")).agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    before = Window.partitionBy(*("o_" + k for k in keys)).orderBy("o___range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*("o_" + k for k in keys), "o___range", *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns))
    d = d.withColumns({f"__i_{c}": F.sum(c).over(w) for c in columns})
    j = d.join(totals, same_keys([*keys, "__range"]))
    return j.select(*df.columns, *((F.col(f"__b_{c}") + F.col(f"__i_{c}")).alias(f"{c}_upto") for c in columns))
