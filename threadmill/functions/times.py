"""Times as whole microseconds, the same under every session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column of ``df``, null for null.

    Parquet timestamps without zone load as TIMESTAMP_NTZ, of which
    ``unix_micros`` would need a cast through the session zone; the parts are
    put together instead.
    """
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c)
    day = F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
    clock = (F.hour(c) * 60 + F.minute(c)).cast("long") * F.lit(60_000_000)
    return day + clock + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def seconds_between(df: DataFrame, later: str, earlier: str) -> Column:
    """Whole seconds (fraction dropped) from one timestamp column to another."""
    return F.floor((micros(df, later) - micros(df, earlier)) / 1_000_000).cast("long")
