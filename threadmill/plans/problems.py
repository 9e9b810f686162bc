"""Queries of the general data problems: sessions (2), increments (3), changes (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import apply_changes
from ..operators.current import latest_by
from ..operators.ledger import take_in
from ..operators.sessions import sessionize
from ..storage import scratch, table
from .registry import Registry

problems = Registry()
GAP_SECONDS = 1800

_CURRENT = """current_messages AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, channel_id DESC, thread_id DESC) AS rn FROM messages) WHERE rn = 1)"""
_SESSIONS = f"""WITH {_CURRENT}, e AS (
  SELECT channel_id, thread_id, id, created_at FROM current_messages
  WHERE deleted_at IS NULL AND NOT author_is_bot AND created_at IS NOT NULL),
g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
  FROM e WINDOW w AS (PARTITION BY channel_id, thread_id ORDER BY created_at, id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY channel_id, thread_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS no FROM g)
"""


def human_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current, undeleted messages of humans."""
    m = table(spark, sf_dir, "messages")
    m = m.select("id", "ingested_at", "channel_id", "thread_id", "created_at", F.col("author_is_bot").alias("bot"), F.col("deleted_at").isNotNull().alias("gone"))
    m = latest_by(m, ["id"], ["ingested_at", "channel_id", "thread_id"])
    return m.where(~F.col("gone") & ~F.col("bot"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(human_events(spark, sf_dir), ["channel_id", "thread_id"], "id", "created_at", GAP_SECONDS)


@problems.query(
    "p2_found",
    _SESSIONS + "SELECT channel_id, arg_min(id, (created_at, id)) AS first_message_id, arg_max(id, (created_at, id)) AS last_message_id, count(*) AS n_messages FROM s GROUP BY channel_id, thread_id, no",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    return s.select("channel_id", F.col("first_id").alias("first_message_id"), F.col("last_id").alias("last_message_id"), F.col("n_events").alias("n_messages"))


@problems.query(
    "p2_sessions",
    _SESSIONS
    + """SELECT channel_id, thread_id, CAST(no + 1 AS BIGINT) AS session_no, arg_min(id, (created_at, id)) AS first_id, arg_max(id, (created_at, id)) AS last_id,
  epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) AS end_us, epoch_us(max(created_at)) - epoch_us(min(created_at)) AS duration_us, count(*) AS n_events
FROM s GROUP BY channel_id, thread_id, no""",
)
def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@problems.query(
    "p3_found",
    """WITH marks AS (SELECT id, max(last_backfilled_message_id) AS mark FROM channels GROUP BY id),
src AS (SELECT * FROM source_messages WHERE NOT is_system),
newest AS (SELECT id, max(edited_at) AS edited_at, max(coalesce(thread_id, channel_id)) AS place FROM src GROUP BY id),
cur AS (SELECT id, edited_at FROM (SELECT id, edited_at, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, edited_at DESC NULLS LAST) AS rn FROM messages) WHERE rn = 1)
SELECT n.id AS message_id FROM newest n LEFT JOIN cur c ON c.id = n.id LEFT JOIN marks m ON m.id = n.place
WHERE (c.id IS NULL AND (m.mark IS NULL OR n.id > m.mark))
   OR (c.id IS NOT NULL AND n.edited_at IS NOT NULL AND (c.edited_at IS NULL OR n.edited_at > c.edited_at))""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = (table(spark, sf_dir, t) for t in ("source_messages", "channels", "messages"))
    return take_in(*read, path=scratch(spark, "ledger"))


_WINNERS = """WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY coalesce(revision, -1) DESC, change_seq DESC) AS rn
  FROM message_changes WHERE op IN ('insert', 'update')) WHERE rn = 1),
d AS (SELECT message_id, max(deleted_at) AS last_delete FROM message_changes WHERE op = 'delete' GROUP BY message_id),
alive AS (SELECT w.*, d.last_delete FROM w LEFT JOIN d USING (message_id)
  WHERE d.last_delete IS NULL OR coalesce(w.edited_at, w.created_at) IS NULL OR NOT d.last_delete > coalesce(w.edited_at, w.created_at))
"""


@problems.query("p7_found", _WINNERS + "SELECT message_id, CAST(revision AS BIGINT) AS revision, change_seq FROM alive")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(table(spark, sf_dir, "message_changes")).select("message_id", F.col("revision").cast("long").alias("revision"), "change_seq")


@problems.query(
    "p7_current",
    _WINNERS
    + """, c AS (SELECT message_id, arg_max(content, (coalesce(revision, -1), change_seq)) AS v, arg_max(coalesce(edited_at, created_at), (coalesce(revision, -1), change_seq)) AS at
  FROM message_changes WHERE op IN ('insert', 'update') AND content IS NOT NULL GROUP BY message_id),
h AS (SELECT message_id, arg_max(channel_id, (coalesce(revision, -1), change_seq)) AS v, arg_max(coalesce(edited_at, created_at), (coalesce(revision, -1), change_seq)) AS at
  FROM message_changes WHERE op IN ('insert', 'update') AND channel_id IS NOT NULL GROUP BY message_id)
SELECT message_id, CAST(revision AS BIGINT) AS revision, change_seq,
  CASE WHEN last_delete IS NULL OR NOT coalesce(last_delete > c.at, false) THEN c.v END AS content,
  CASE WHEN last_delete IS NULL OR NOT coalesce(last_delete > h.at, false) THEN h.v END AS channel_id
FROM alive LEFT JOIN c USING (message_id) LEFT JOIN h USING (message_id)""",
)
def p7_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = apply_changes(table(spark, sf_dir, "message_changes"), ("content", "channel_id"))
    return s.withColumn("revision", F.col("revision").cast("long"))
