"""Reading exports and writing archives, labels and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One export file: a guild, a channel and its messages; ids are strings.
EXPORT_SCHEMA = """
guild struct<id: string, name: string>,
channel struct<id: string, type: string, categoryId: string, name: string>,
messages array<struct<id: string, type: string, timestamp: string, timestampEdited: string, content: string,
  author: struct<id: string, name: string, nickname: string, isBot: boolean>,
  attachments: array<struct<id: string, url: string, fileName: string, fileSizeBytes: bigint>>,
  reactions: array<struct<emoji: struct<name: string, code: string>, count: int>>,
  reference: struct<messageId: string>>>
"""


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of chat exports (JSON files at any depth); a malformed file fails the job.

    The nickname counts before the name; a message is a system record unless
    its type is Default or Reply; reactions without a count are dropped; a
    channel is a thread if its type says so, and categoryId is its parent.
    """
    raw = spark.read.schema(EXPORT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    m = raw.select("guild", "channel", F.explode("messages").alias("m"))
    thread = F.col("channel.type").contains("Thread")
    return m.select(
        F.col("m.id").cast("long").alias("id"),
        F.col("channel.id").cast("long").alias("channel_id"),
        F.col("guild.id").cast("long").alias("guild_id"),
        F.col("channel.name").alias("channel_name"),
        F.when(thread, "thread").otherwise("text").alias("kind"),
        F.when(thread, F.col("channel.categoryId").cast("long")).alias("parent_id"),
        F.col("m.author.id").cast("long").alias("author_id"),
        F.coalesce("m.author.nickname", "m.author.name").alias("author_name"),
        F.coalesce("m.author.isBot", F.lit(False)).alias("author_is_bot"),
        (~F.coalesce(F.col("m.type").isin("Default", "Reply"), F.lit(False))).alias("is_system"),
        F.to_timestamp("m.timestamp").alias("created_at"),
        F.to_timestamp("m.timestampEdited").alias("edited_at"),
        F.col("m.content").alias("content"),
        F.col("m.reference.messageId").cast("long").alias("reply_to_id"),
        F.filter("m.reactions", lambda r: r["count"] > 0).alias("reactions"),
        F.col("m.attachments").alias("attachments"),
    )


def export_archive(messages: DataFrame, groups: DataFrame, archived: DataFrame, opted_out: DataFrame, path: str) -> DataFrame:
    """Write the shareable messages of archived exchanges without author ids or raw payloads; returns what was written.

    ``groups``: xid, id, position; ``archived``: xid.  The write commits at
    once, so readers never see half of it; an existing target is an error.
    """
    keep = messages.join(opted_out.select("author_id").distinct(), "author_id", "left_anti").where("deleted_at IS NULL AND content <> '[redacted]'")
    rows = groups.join(archived.select("xid").distinct(), "xid", "left_semi").join(keep.select("id", "channel_id", "created_at", "content"), "id")
    rows.select("xid", "position", "id", "channel_id", "created_at", "content").write.mode("errorifexists").parquet(path)
    return messages.sparkSession.read.parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """A copy of a table; refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)


def export_labels(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, one per labelled exchange."""
    rows.write.mode("errorifexists").json(path)


def log_line(ts: Column, channel: Column, author: Column, ids: list[tuple[str, Column]], text: Column, limit: int = 300) -> Column:
    """A log line: time #channel author [name:id ...] text, blanks collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)
    tags = F.concat_ws(" ", *(F.concat(F.lit(n + ":"), c.cast("string")) for n, c in ids))
    return F.concat_ws(" ", ts.cast("string"), F.concat(F.lit("#"), channel), author, F.concat(F.lit("["), tags, F.lit("]")), cut)


def import_labels(messages: DataFrame, kept: DataFrame | None, patterns: list[str]) -> DataFrame:
    """Labels of a reviewed batch: id, label.  An exact list of kept ids wins over trash patterns."""
    if kept is not None:
        k = kept.select(F.col("id").cast("long").alias("k_id")).distinct()
        return messages.join(k, F.col("id") == F.col("k_id"), "left").select("id", F.when(F.col("k_id").isNull(), "trash").otherwise("keep").alias("label"))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col("content").rlike(p), F.lit(False))
    return messages.select("id", F.when(hit, "trash").otherwise("keep").alias("label"))
