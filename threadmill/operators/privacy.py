"""Opt-outs applied to views, and what edits make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros

MARK = "[redacted]"


def redacted(messages: DataFrame, opted_out: DataFrame, columns: list[str]) -> DataFrame:
    """``messages`` with the given columns replaced for authors who opted out (author_id).

    Applied in the view that everything reads, so later steps and indexes
    never see what is withheld; stored partitions can be rewritten from it.
    """
    o = opted_out.select(F.col("author_id").alias("o_id")).distinct().withColumn("out", F.lit(True))
    j = messages.join(o, F.col("author_id") == F.col("o_id"), "left")
    return j.select(*(F.when(F.col("out"), F.lit(MARK)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in messages.columns))


def stale_groups(members: DataFrame, edits: DataFrame) -> DataFrame:
    """Exchanges of which a message was edited after the exchange ended: xid, n_edits.

    ``members``: xid, id, us; ``edits``: id, edited_at (the latest).
    """
    e = edits.select(F.col("id").alias("e_id"), micros(edits, "edited_at").alias("e_us"))
    done = members.groupBy("xid").agg(F.max("us").alias("done_us"))
    j = members.join(e, F.col("id") == F.col("e_id")).select("xid", "e_us").join(done, "xid")
    return j.where("e_us > done_us").groupBy("xid").agg(F.count("*").alias("n_edits"))
