"""Sessions between quiet gaps, by start-end pairing.

Events are first thinned: within a slot of one gap's width all events of a key
lie less than a gap apart, so only the slot's first and last event and its
count matter.  That aggregation combines map-side; what is left per key is
bounded by time span / gap, whatever share of the rows the key holds, so the
windows below never see an unbounded group.  RANGE frames then find the events
without a neighbour within the gap before (starts) or after (ends); both are
numbered separately, equal numbers are joined, and the count of a session is
the difference of its ends' ranks among all events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros


def sessionize(events: DataFrame, keys: Sequence[str], id_col: str, time_col: str, gap_seconds: int) -> DataFrame:
    """One row per session of each key.

    A session starts where more than ``gap_seconds`` passed since the event
    before; exactly the gap stays together.  Events are ordered by time, then
    id.  Rows without a time or id are left out; a null key value is a value
    of its own; an empty table gives no session; repeated rows count as often
    as they occur (make ids unique first).  Columns of ``events`` besides those
    named are ignored.  Result: keys, session_no (1-based per key),
    first_id, last_id, start_us, end_us, duration_us, n_events.
    """
    gap = gap_seconds * 1_000_000
    k = [f"k{i}" for i in range(len(keys))]
    e = events.select(*(F.col(c).alias(a) for a, c in zip(k, keys)), F.col(id_col).alias("id"), micros(events, time_col).alias("us"))
    e = e.where(F.col("us").isNotNull() & F.col("id").isNotNull())
    slots = e.groupBy(*k, (F.col("us") - F.pmod(F.col("us"), F.lit(gap))).alias("slot")).agg(F.min(F.struct("us", "id")).alias("first"), F.max(F.struct("us", "id")).alias("last"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*k).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("upto", upto)
    edges = slots.select(
        *k,
        F.explode(
            F.when(F.col("n") == 1, F.array(F.struct("first.us", "first.id", F.col("upto").alias("rank")))).otherwise(
                F.array(F.struct("first.us", "first.id", (F.col("upto") - F.col("n") + 1).alias("rank")), F.struct("last.us", "last.id", F.col("upto").alias("rank")))
            )
        ).alias("edge"),
    ).select(*k, "edge.*")
    by_time = Window.partitionBy(*k).orderBy("us")
    near = edges.withColumn("before", F.count("*").over(by_time.rangeBetween(-gap, -1))).withColumn("after", F.count("*").over(by_time.rangeBetween(1, gap)))
    # Edges at one time: of a slot both its ends, so the lower rank starts and the higher ends.
    near = near.withColumn("low", F.min("rank").over(by_time.rangeBetween(0, 0))).withColumn("high", F.max("rank").over(by_time.rangeBetween(0, 0)))
    by_rank = Window.partitionBy(*k).orderBy("rank")
    starts = near.where((F.col("before") == 0) & (F.col("rank") == F.col("low"))).withColumn("no", F.row_number().over(by_rank))
    ends = near.where((F.col("after") == 0) & (F.col("rank") == F.col("high"))).withColumn("no", F.row_number().over(by_rank))
    s, t = starts.alias("s"), ends.alias("t")
    same = F.col("s.no") == F.col("t.no")
    for c in k:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    return s.join(t, same).select(
        *(F.col(f"s.{a}").alias(c) for a, c in zip(k, keys)),
        F.col("s.no").cast("long").alias("session_no"),
        F.col("s.id").alias("first_id"),
        F.col("t.id").alias("last_id"),
        F.col("s.us").alias("start_us"),
        F.col("t.us").alias("end_us"),
        (F.col("t.us") - F.col("s.us")).alias("duration_us"),
        (F.col("t.rank") - F.col("s.rank") + 1).alias("n_events"),
    )
