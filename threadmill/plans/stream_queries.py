"""Streams, sources and sinks, each run once over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..sources import archive as A
from ..storage import scratch, table
from ..streaming import pipeline as P
from .base import SQL_CUR, SQL_EM, current, exchange_messages
from .registry import CORE


@CORE.query(
    "streaming_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g), m AS (SELECT max(ts) AS t FROM events)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s, m GROUP BY user_id, no, t HAVING max(ts) + INTERVAL 6 HOUR < t - INTERVAL 1 HOUR""",
)
def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = P.sessions(P.read_files(spark, path, schema), ["user_id"], "ts", 6 * 3600, "1 hour")
    out, mark = scratch(spark, "stream"), scratch(spark, "mark")
    P.append_rows(s, out, mark).awaitTermination()
    r = spark.read.schema(s.schema).parquet(out)
    return r.select("user_id", micros(r, "start").alias("start_us"), micros(r, "last").alias("last_us"), "n")


@CORE.query("streaming_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = scratch(spark, "ingest")
    P.write_batches(P.read_files(spark, path, schema), out, scratch(spark, "mark")).awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out).select("event_id", "user_id", "event_type", "value")


@CORE.query("late_rows", "SELECT event_id FROM events WHERE event_id % 10 = 3")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return P.catch_up(e, e.where("event_id % 10 <> 3"), "event_id").select("event_id")


@CORE.query(
    "archive_export",
    f"WITH {SQL_EM}, o AS (SELECT DISTINCT author_id FROM cur WHERE author_id % 7 = 0) SELECT xid, count(*) AS n_messages, min(position) AS first_position FROM em WHERE xid % 2 = 0 AND author_id NOT IN (SELECT author_id FROM o) AND content <> '' GROUP BY xid",
)
def archive_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir)
    m = current(spark, sf_dir, "author_id", "channel_id", "created_at", "content", "deleted_at").where("content <> ''")
    w = A.export_archive(m, em.select("xid", "id", "position"), em.where("xid % 2 = 0").select("xid"), m.where("author_id % 7 = 0"), scratch(spark, "archive"))
    return w.groupBy("xid").agg(F.count("*").alias("n_messages"), F.min("position").alias("first_position"))


@CORE.query(
    "batch_log",
    f"WITH {SQL_CUR}, t AS (SELECT id, author_name_at_time AS a, channel_id AS c, trim(regexp_replace(coalesce(content, ''), '[\\s\\x0b]+', ' ', 'g')) AS flat, epoch_us(created_at) AS us FROM cur WHERE created_at IS NOT NULL)"
    " SELECT id, us || ' #' || c || ' ' || a || ' [msg:' || id || '] ' || CASE WHEN length(flat) > 60 THEN left(flat, 59) || '…' ELSE flat END AS line FROM t",
)
def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = current(spark, sf_dir, "channel_id", "author_name_at_time", "created_at", "content")
    m = m.withColumn("us", micros(m, "created_at")).where("us IS NOT NULL")
    return m.select("id", A.log_line(F.col("us"), F.col("channel_id").cast("string"), F.col("author_name_at_time"), [("msg", F.col("id"))], F.coalesce("content", F.lit("")), 60).alias("line"))


@CORE.query("label_import", f"WITH {SQL_CUR} SELECT CASE WHEN regexp_matches(coalesce(content, ''), '(?i)^(lol|welcome)') OR regexp_matches(coalesce(content, ''), '^Back in') THEN 'trash' ELSE 'keep' END AS label, count(*) AS n FROM cur GROUP BY 1")
def label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.import_labels(current(spark, sf_dir, "content"), None, ["(?i)^(lol|welcome)", "^Back in"]).groupBy("label").agg(F.count("*").alias("n"))
