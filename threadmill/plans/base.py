"""The tables that the queries below work on, in Spark and in SQL.

Exchanges are what the grouping pipeline makes: threads, reply components and
quiet gaps per channel, small ones folded into a neighbour, large ones split.
An exchange is named by its first message and holds at most 50, so windows over
one are bounded.  Like any stored table, the table of exchanges is made once
per session and input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import grouping as G
from ..operators.current import latest_by
from ..storage import settle, stamp, table

SQL_CUR = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1)"""
MIN = 60_000_000
SQL_POOL = SQL_CUR + """,
pool AS (SELECT id, channel_id, thread_id, author_id, reply_to_id, epoch_us(created_at) AS us FROM cur WHERE deleted_at IS NULL AND NOT author_is_bot AND created_at IS NOT NULL)"""
SQL_ROOTS = """rest AS (SELECT * FROM pool WHERE thread_id IS NULL),
up AS (SELECT r.id, t.id AS parent FROM rest r LEFT JOIN rest t ON t.id = r.reply_to_id AND t.channel_id = r.channel_id AND t.id <> r.id),
walked AS (SELECT id, id AS root FROM up WHERE parent IS NULL UNION ALL SELECT u.id, w.root FROM walked w JOIN up u ON u.parent = w.id),
stuck AS (SELECT id, parent FROM up WHERE id NOT IN (SELECT id FROM walked)),
reach(id, cur) AS (SELECT id, parent FROM stuck UNION SELECT r.id, s.parent FROM reach r JOIN stuck s ON s.id = r.cur),
walk AS (SELECT id, root FROM walked UNION ALL SELECT id, min(cur) FROM reach WHERE cur IN (SELECT id FROM reach WHERE id = cur) GROUP BY id)"""


def sql_quiet(minutes: int, source: str = "pool", keys: str = "channel_id") -> str:
    return f"""(SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY us, id) AS group_no FROM
  (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {keys} ORDER BY us, id) > {minutes * MIN} THEN 1 ELSE 0 END AS fresh FROM {source}))"""


SQL_EVERY = f"""{SQL_POOL}, {SQL_ROOTS}, big AS (SELECT root FROM walk GROUP BY root HAVING count(*) > 1),
chained AS (SELECT w.id, w.root FROM walk w JOIN big USING (root)), left_over AS (SELECT * FROM rest WHERE id NOT IN (SELECT id FROM chained)),
every AS (SELECT id, us, channel_id, reply_to_id, 'thread' AS rule, 't:' || channel_id || ':' || thread_id AS key FROM pool WHERE thread_id IS NOT NULL
  UNION ALL SELECT c.id, p.us, p.channel_id, p.reply_to_id, 'reply_chain', 'r:' || root FROM chained c JOIN pool p ON p.id = c.id
  UNION ALL SELECT id, us, channel_id, reply_to_id, 'quiet_gap', 'q:' || channel_id || ':' || group_no FROM {sql_quiet(30, 'left_over')})"""
SQL_PARTS = f"""{SQL_EVERY},
grp AS (SELECT channel_id, key, rule, count(*) AS n, min(us) AS lo, arg_min(id, (us, id)) AS lo_id, max(us) AS hi FROM every GROUP BY ALL),
pairs AS (SELECT a.key AS x, b.key AS y FROM every a JOIN every b ON b.id = a.reply_to_id WHERE a.key <> b.key),
kin AS (SELECT x AS key, list(y) AS others FROM (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs) GROUP BY x),
g AS (SELECT grp.*, coalesce(others, []) AS others, row_number() OVER (PARTITION BY channel_id ORDER BY lo, lo_id) AS no FROM grp LEFT JOIN kin USING (key)),
scan AS (
  SELECT channel_id, CAST(0 AS BIGINT) AS no, '' AS key, '' AS target, '' AS r_key, CAST(0 AS BIGINT) AS r_n, CAST(0 AS BIGINT) AS r_hi, '' AS r_rule, CAST([] AS VARCHAR[]) AS r_keys,
    CAST(0 AS BIGINT) AS h_n, CAST(0 AS BIGINT) AS h_hi, CAST([] AS VARCHAR[]) AS h_keys FROM (SELECT DISTINCT channel_id FROM g)
  UNION ALL
  SELECT channel_id, no, key, CASE choice WHEN 'before' THEN r_key WHEN 'after' THEN x_key ELSE key END,
    CASE choice WHEN 'none' THEN key ELSE r_key END, CASE choice WHEN 'none' THEN c_n WHEN 'before' THEN r_n + c_n ELSE r_n END, CASE choice WHEN 'none' THEN c_hi WHEN 'before' THEN greatest(r_hi, c_hi) ELSE r_hi END,
    CASE choice WHEN 'none' THEN rule ELSE r_rule END, CASE choice WHEN 'none' THEN c_keys WHEN 'before' THEN list_concat(r_keys, c_keys) ELSE r_keys END,
    CASE choice WHEN 'after' THEN c_n ELSE 0 END, CASE choice WHEN 'after' THEN c_hi ELSE 0 END, CASE choice WHEN 'after' THEN c_keys ELSE [] END
  FROM (SELECT *, CASE WHEN before_ok AND after_ok THEN CASE WHEN (NOT after_kin, greatest(0, x_lo - c_hi)) < (NOT before_kin, greatest(0, lo - r_hi)) THEN 'after' ELSE 'before' END WHEN before_ok THEN 'before' WHEN after_ok THEN 'after' ELSE 'none' END AS choice
    FROM (SELECT *, coalesce(small AND r_key <> '' AND lo - r_hi <= {120 * MIN} AND r_n > 1 AND r_n + c_n <= 50 AND (before_kin OR r_rule <> 'thread'), false) AS before_ok,
        coalesce(small AND x_lo - c_hi <= {120 * MIN} AND x_n > 1 AND x_n + c_n <= 50 AND (after_kin OR x_rule <> 'thread'), false) AS after_ok
      FROM (SELECT c.channel_id, c.no, c.key, c.rule, c.lo, s.r_key, s.r_n, s.r_hi, s.r_rule, s.r_keys, c.n + s.h_n AS c_n, greatest(c.hi, s.h_hi) AS c_hi, list_concat([c.key], s.h_keys) AS c_keys,
          c.n + s.h_n <= 1 AND c.rule <> 'thread' AS small, list_has_any(c.others, s.r_keys) AS before_kin, coalesce(list_contains(c.others, x.key), false) AS after_kin, x.key AS x_key, x.n AS x_n, x.lo AS x_lo, x.rule AS x_rule
        FROM scan s JOIN g c ON c.channel_id = s.channel_id AND c.no = s.no + 1 LEFT JOIN g x ON x.channel_id = c.channel_id AND x.no = c.no + 1)))),
m AS (SELECT e.channel_id, e.id, e.us, s.target AS key FROM every e JOIN scan s ON s.key = e.key AND s.no > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, id) - 1 AS p, count(*) OVER (PARTITION BY key) AS n FROM m),
d AS (SELECT *, us - lag(us) OVER (PARTITION BY key ORDER BY p) AS gap FROM o),
j AS (SELECT key, p, n, arg_max(p, (gap, p)) OVER (PARTITION BY key ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING) AS q FROM d),
cuts AS (SELECT key, CAST(0 AS BIGINT) AS p FROM (SELECT DISTINCT key FROM m) UNION ALL SELECT j.key, j.q FROM cuts JOIN j ON j.key = cuts.key AND j.p = cuts.p WHERE j.n - j.p > 50),
f AS (SELECT o.*, max(c.p) OVER (PARTITION BY o.key ORDER BY o.p) AS head FROM o LEFT JOIN cuts c ON c.key = o.key AND c.p = o.p),
h AS (SELECT f.channel_id, f.key, f.id, f.p, f.head, t.id AS part FROM f JOIN o t ON t.key = f.key AND t.p = f.head)
"""

SQL_EM = (
    SQL_CUR
    + f""",
em AS MATERIALIZED (WITH RECURSIVE {SQL_PARTS.removeprefix(SQL_CUR + ",").lstrip()}
  SELECT h.part AS xid, CAST(h.p - h.head AS BIGINT) AS position, c.id, c.channel_id, c.thread_id, c.author_id, c.author_name_at_time AS name, c.author_is_bot AS bot, epoch_us(c.created_at) AS us, coalesce(c.content, '') AS content, c.reply_to_id
  FROM h JOIN cur c ON c.id = h.id)"""
)
SQL_LATEST_CHANNELS = """chan AS (SELECT id, arg_max(parent_id, coalesce(last_backfilled_message_id, -1)) AS parent_id, max(name) AS name, max(kind) AS kind, max(last_backfilled_message_id) AS mark FROM channels GROUP BY id)"""


def current(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The given columns (and id) of the current row of every message, deleted ones included.

    Columns are named because the latest row is found by one aggregate over
    them: what isn't named is neither read nor shuffled.
    """
    return latest_by(table(spark, sf_dir, "messages"), ["id"], ["ingested_at"], columns)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that can be grouped: current, not deleted, by humans, with a time."""
    m = current(spark, sf_dir, "channel_id", "author_id", "author_is_bot", "created_at", "reply_to_id", "thread_id", "deleted_at")
    m = m.withColumn("us", micros(m, "created_at")).where("deleted_at IS NULL AND NOT author_is_bot AND us IS NOT NULL")
    return m.select("id", "channel_id", "thread_id", "author_id", "reply_to_id", "us")


def exchange_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel_id, id, part, position, is_context of all exchanges."""
    p = settle(pool(spark, sf_dir), "pool")
    return G.final_groups(p, G.exchange_keys(p, 30 * MIN), fold_us=120 * MIN, small=1, most=50, overlap=3)


_stored: dict[tuple, DataFrame] = {}


def exchange_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xid, position, id, channel_id, thread_id, author_id, name, bot, us, content, reply_to_id; made once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, f"{sf_dir}/messages.parquet"))
    if key not in _stored:
        m = current(spark, sf_dir, "channel_id", "thread_id", "author_id", "author_name_at_time", "author_is_bot", "created_at", "content", "reply_to_id")
        m = m.withColumn("us", micros(m, "created_at"))
        parts = exchange_parts(spark, sf_dir).where("NOT is_context").select(F.col("id").alias("p_id"), F.col("part").alias("xid"), "position")
        j = m.join(parts, F.col("id") == F.col("p_id"))
        one = j.select("xid", "position", "id", "channel_id", "thread_id", "author_id", F.col("author_name_at_time").alias("name"), F.col("author_is_bot").alias("bot"), "us", F.coalesce("content", F.lit("")).alias("content"), "reply_to_id")
        _stored[key] = settle(one, "exchanges")
    return _stored[key]


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per channel: the greatest checkpoint stays."""
    c = table(spark, sf_dir, "channels")
    mark = F.coalesce("last_backfilled_message_id", F.lit(-1))
    return c.groupBy("id").agg(F.max_by("parent_id", mark).alias("parent_id"), F.max("name").alias("name"), F.max("kind").alias("kind"), F.max("last_backfilled_message_id").alias("mark"))
