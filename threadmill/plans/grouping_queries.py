"""Grouping messages into exchanges, and comparing two ways of doing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import bucket
from ..operators import grouping as G
from ..operators.order import numbered
from ..storage import settle
from .base import MIN, SQL_EVERY, SQL_PARTS, SQL_POOL, SQL_ROOTS, exchange_parts, pool, sql_quiet
from .registry import CORE

@CORE.query("thread_groups", f"WITH {SQL_POOL} SELECT thread_id, count(*) AS n, arg_min(id, (us, id)) AS first_id, arg_max(id, (us, id)) AS last_id FROM pool WHERE thread_id IS NOT NULL GROUP BY thread_id")
def thread_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("us", "id")
    return pool(spark, sf_dir).where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.count("*").alias("n"), F.min(at)["id"].alias("first_id"), F.max(at)["id"].alias("last_id"))


@CORE.query("reply_components", f"WITH RECURSIVE {SQL_POOL}, {SQL_ROOTS} SELECT id, root FROM walk")
def reply_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reply_components(pool(spark, sf_dir).where("thread_id IS NULL"))


@CORE.query(
    "exchange_groups",
    f"WITH RECURSIVE {SQL_EVERY} SELECT rule, arg_min(id, (us, id)) AS first_id, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY us, id)) AS content_hash FROM every GROUP BY rule, key",
)
def exchange_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(pool(spark, sf_dir), "pool")
    k = G.exchange_keys(p, 30 * MIN)
    j = k.join(p.select("id", "us"), "id")
    first = j.groupBy("rule", "key").agg(F.min(F.struct("us", "id"))["id"].alias("first_id"))
    return G.content_hash(j, "key").join(first, "key").select("rule", "first_id", "n", "content_hash")


@CORE.query(
    "adaptive_channel_gap",
    f"""WITH {SQL_POOL}, g AS (SELECT channel_id, us - lag(us) OVER (PARTITION BY channel_id ORDER BY us, id) AS gap FROM pool)
SELECT channel_id, greatest(coalesce(quantile_disc(CASE WHEN gap <= 21600000000 THEN gap END, 0.95) / 1e6, 0), 1800.0) AS gap_s FROM g GROUP BY channel_id""",
)
def adaptive_channel_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adaptive_gap(pool(spark, sf_dir), 95, 1800, 21600)


@CORE.query(
    "adaptive_groups",
    f"""WITH {SQL_POOL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY channel_id ORDER BY us, id) AS gap FROM pool),
lim AS (SELECT channel_id, greatest(coalesce(quantile_disc(CASE WHEN gap <= 21600000000 THEN gap END, 0.95) / 1e6, 0), 1800.0) * 1e6 AS lim FROM g GROUP BY channel_id),
f AS (SELECT g.*, CASE WHEN gap > lim THEN 1 ELSE 0 END AS fresh FROM g JOIN lim USING (channel_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY channel_id ORDER BY us, id) AS no FROM f)
SELECT channel_id, arg_min(id, (us, id)) AS first_id, count(*) AS n FROM s GROUP BY channel_id, no""",
)
def adaptive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(pool(spark, sf_dir), "pool")
    lim = G.adaptive_gap(p, 95, 1800, 21600).select(F.col("channel_id").alias("l_channel"), (F.col("gap_s") * 1e6).alias("lim"))
    j = p.join(lim, F.col("channel_id") == F.col("l_channel")).drop("l_channel")
    s = G.by_quiet_gap(j, ["channel_id"], F.col("lim"), 1800 * 1_000_000)
    return s.groupBy("channel_id", "group_no").agg(F.min(F.struct("us", "id"))["id"].alias("first_id"), F.count("*").alias("n")).drop("group_no")


@CORE.query(
    "closed_groups",
    f"""WITH {SQL_POOL}, s AS {sql_quiet(30)}, now AS (SELECT max(us) - {24 * 60 * MIN} AS t FROM pool)
SELECT channel_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s, now GROUP BY channel_id, group_no, t HAVING t - max(us) > {30 * MIN}""",
)
def closed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(pool(spark, sf_dir), "pool")
    now = p.agg((F.max("us") - 24 * 60 * MIN).alias("t"))
    s = G.by_quiet_gap(p, ["channel_id"], F.lit(30 * MIN), 30 * MIN).groupBy("channel_id", "group_no").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"))
    return s.join(F.broadcast(now), F.col("t") - F.col("end_us") > 30 * MIN).select("channel_id", "start_us", "end_us", "n")


_SIZES = [(1, "1"), (2, "2"), (5, "3-5"), (15, "6-15"), (49, "16-49")]
_CASE = "CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 15 THEN '6-15' WHEN n <= 49 THEN '16-49' ELSE 'cap' END"


@CORE.query(
    "measure_gaps",
    f"WITH {SQL_POOL}, " + ", ".join(f"s{m} AS (SELECT {m} AS minutes, channel_id, group_no, count(*) AS n FROM {sql_quiet(m)} GROUP BY channel_id, group_no)" for m in (30, 60, 120, 240))
    + f" SELECT CAST(minutes AS BIGINT) AS minutes, {_CASE} AS size, count(*) AS groups, CAST(sum(n) AS BIGINT) AS messages FROM (" + " UNION ALL ".join(f"SELECT * FROM s{m}" for m in (30, 60, 120, 240)) + ") GROUP BY 1, 2",
)
def measure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(pool(spark, sf_dir), "pool")
    every = None
    for m in (30, 60, 120, 240):
        s = G.by_quiet_gap(p, ["channel_id"], F.lit(m * MIN), m * MIN).groupBy("channel_id", "group_no").agg(F.count("*").alias("n")).select(F.lit(m).cast("long").alias("minutes"), "n")
        every = s if every is None else every.unionByName(s)
    return every.groupBy("minutes", bucket(F.col("n"), _SIZES, "cap").alias("size")).agg(F.count("*").alias("groups"), F.sum("n").alias("messages"))


def _grouped(p: DataFrame, minutes: int) -> DataFrame:
    s = G.by_quiet_gap(p, ["channel_id"], F.lit(minutes * MIN), minutes * MIN)
    first = s.groupBy("channel_id", "group_no").agg(F.min(F.struct("us", "id"))["id"].alias("group_id"))
    return settle(s.join(first, ["channel_id", "group_no"]).select("group_id", "id"), "grouped")


_REMAP = f"""WITH {SQL_POOL}, a AS (SELECT id, first_value(id) OVER (PARTITION BY channel_id, group_no ORDER BY us, id) AS old_id FROM {sql_quiet(60)}),
b AS (SELECT id, first_value(id) OVER (PARTITION BY channel_id, group_no ORDER BY us, id) AS new_id FROM {sql_quiet(20)}),
sh AS (SELECT old_id, new_id, count(*) AS shared FROM a JOIN b USING (id) GROUP BY ALL), o AS (SELECT old_id, count(*) AS old_n FROM a GROUP BY ALL), n AS (SELECT new_id, count(*) AS new_n FROM b GROUP BY ALL),
best AS (SELECT old_id, arg_max(new_id, (shared, new_id)) AS new_id, max(shared) AS shared FROM sh GROUP BY old_id),
moved AS (SELECT old_id, CASE WHEN shared * 2 > old_n THEN new_id END AS new_id,
  CASE WHEN NOT shared * 2 > old_n THEN 'ambiguous' WHEN shared < old_n THEN 'split' WHEN new_n = old_n THEN 'one_to_one' ELSE 'merged' END AS kind, shared, old_n FROM best JOIN o USING (old_id) JOIN n USING (new_id))
"""


@CORE.query("rechunk_remap", _REMAP + "SELECT old_id, coalesce(new_id, 0) AS new_id, kind, shared, old_n FROM moved")
def rechunk_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(pool(spark, sf_dir), "pool")
    return G.remap(_grouped(p, 60), _grouped(p, 20)).withColumn("new_id", F.coalesce("new_id", F.lit(0)))


@CORE.query(
    "label_carry_over",
    _REMAP
    + ", l AS (SELECT old_id, CASE WHEN old_id % 3 = 0 THEN 'relevant' ELSE 'irrelevant' END AS label FROM o) SELECT new_id, coalesce(CASE WHEN min(label) = max(label) THEN min(label) END, '') AS label, CASE WHEN min(label) = max(label) THEN 'copied' ELSE 'conflict' END AS state FROM moved JOIN l USING (old_id) WHERE new_id IS NOT NULL GROUP BY new_id",
)
def label_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = settle(pool(spark, sf_dir), "pool")
    old = _grouped(p, 60)
    labels = old.select(F.col("group_id").alias("old_id")).distinct().withColumn("label", F.when(F.col("old_id") % 3 == 0, "relevant").otherwise("irrelevant"))
    return G.carry_labels(labels, G.remap(old, _grouped(p, 20))).withColumn("label", F.coalesce("label", F.lit("")))


@CORE.query(
    "group_parents",
    f"""WITH RECURSIVE {SQL_PARTS},
cx AS (SELECT a.part, b.id, b.p - a.p AS position FROM h a JOIN h b ON b.key = a.key AND b.p BETWEEN a.p - 3 AND a.p - 1 JOIN h z ON z.key = a.key AND z.p = a.p - 1 AND z.head = b.head WHERE a.p = a.head AND a.p > 0),
c1 AS (SELECT cx.part, arg_min(h.part, position) AS p1 FROM cx JOIN h ON h.id = cx.id GROUP BY cx.part),
hd AS (SELECT h.part, pool.us, pool.reply_to_id, pool.thread_id FROM h JOIN pool ON pool.id = h.part WHERE h.id = h.part),
c2 AS (SELECT hd.part, h.part AS p2 FROM hd JOIN h ON h.id = hd.reply_to_id WHERE h.part <> hd.part),
c3 AS (SELECT part, lag(part) OVER (PARTITION BY thread_id ORDER BY us, part) AS p3 FROM hd WHERE thread_id IS NOT NULL)
SELECT hd.part, coalesce(p1, p2, p3) AS parent FROM hd LEFT JOIN c1 USING (part) LEFT JOIN c2 USING (part) LEFT JOIN c3 USING (part) WHERE coalesce(p1, p2, p3) <> hd.part""",
)
def group_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange that each one continues."""
    return G.parents(settle(exchange_parts(spark, sf_dir), "parts"), pool(spark, sf_dir))


_GAPS = "SELECT channel_id, greatest(coalesce(quantile_disc(CASE WHEN gap <= 21600000000 THEN gap END, 0.95) / 1e6, 0), 1800.0) AS gap_s FROM (SELECT channel_id, us - lag(us) OVER (PARTITION BY channel_id ORDER BY us, id) AS gap FROM {}) GROUP BY channel_id"


@CORE.query(
    "frozen_gaps",
    f"WITH {SQL_POOL}, mid AS (SELECT (min(us) + max(us)) // 2 AS t FROM pool), early AS (SELECT pool.* FROM pool, mid WHERE us < t), a AS ({_GAPS.format('early')}), b AS ({_GAPS.format('pool')})"
    " SELECT channel_id, CAST(floor(gap_s) AS BIGINT) AS gap_s FROM a UNION ALL SELECT channel_id, CAST(floor(gap_s) AS BIGINT) FROM b WHERE channel_id NOT IN (SELECT channel_id FROM a)",
)
def frozen_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps that the first half of the time gave stay; channels of the second half are added."""
    p = settle(pool(spark, sf_dir), "pool")
    mid = F.broadcast(p.agg(F.expr("(min(us) + max(us)) div 2").alias("t")))  # one row
    early = p.join(mid, F.col("us") < F.col("t")).drop("t")
    recorded = G.adaptive_gap(early, 95, 1800, 21600).select("channel_id", F.floor("gap_s").cast("long").alias("gap_s"))
    return G.frozen_gaps(recorded, G.adaptive_gap(p, 95, 1800, 21600))


@CORE.query(
    "measure_adaptive",
    f"""WITH {SQL_POOL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY channel_id ORDER BY us, id) AS gap FROM pool), lim AS (SELECT channel_id, gap_s * 1e6 AS lim FROM ({_GAPS.format('pool')})),
s AS (SELECT channel_id, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY us, id) AS no FROM g JOIN lim USING (channel_id)), z AS (SELECT channel_id, no, count(*) AS n FROM s GROUP BY ALL)
SELECT channel_id, {_CASE} AS size, count(*) AS groups, CAST(sum(n) AS BIGINT) AS messages FROM z GROUP BY 1, 2""",
)
def measure_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the groups that each channel's own gap makes."""
    p = settle(pool(spark, sf_dir), "pool")
    lim = G.adaptive_gap(p, 95, 1800, 21600).select(F.col("channel_id").alias("l_channel"), (F.col("gap_s") * 1e6).alias("lim"))
    s = G.by_quiet_gap(p.join(lim, F.col("channel_id") == F.col("l_channel")).drop("l_channel"), ["channel_id"], F.col("lim"), 1800 * 1_000_000)
    z = s.groupBy("channel_id", "group_no").agg(F.count("*").alias("n"))
    return z.groupBy("channel_id", bucket(F.col("n"), _SIZES, "cap").alias("size")).agg(F.count("*").alias("groups"), F.sum("n").alias("messages"))


@CORE.query(
    "rechunk_slices",
    _REMAP + ", sl AS (SELECT CASE WHEN old_id % 2 = 0 THEN 'build' ELSE 'holdout' END AS slice, old_id, row_number() OVER (ORDER BY old_id) AS no FROM o), j AS (SELECT slice, new_id, min(no) AS first FROM sl JOIN moved USING (old_id) WHERE new_id IS NOT NULL GROUP BY ALL) SELECT slice || '@r2' AS slice, row_number() OVER (PARTITION BY slice ORDER BY first) - 1 AS no, new_id AS group_id FROM j",
)
def rechunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices of the old groups under the new recipe, in order."""
    p = settle(pool(spark, sf_dir), "pool")
    old = _grouped(p, 60)
    ids = numbered(old.select(F.col("group_id").alias("old_id")).distinct(), [], ["old_id"])
    slices = ids.select(F.when(F.col("old_id") % 2 == 0, "build").otherwise("holdout").alias("slice"), (F.col("no") + 1).alias("no"), F.col("old_id").alias("group_id"))
    return G.carry_slices(slices, G.remap(old, _grouped(p, 20)), "r2")


@CORE.query(
    "rechunk_applied",
    _REMAP + ", hit AS (SELECT DISTINCT old_id FROM a WHERE id % 10 = 0) SELECT old_id AS group_id, id, 1 AS version, CASE WHEN old_id IN (SELECT old_id FROM hit) THEN 2 ELSE 0 END AS superseded_by FROM a UNION ALL SELECT new_id, id, 2, 0 FROM b WHERE id IN (SELECT id FROM a WHERE old_id IN (SELECT old_id FROM hit))",
)
def rechunk_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership after every group with an id divisible by ten was regrouped."""
    p = settle(pool(spark, sf_dir), "pool")
    old, new = _grouped(p, 60), _grouped(p, 20)
    members = old.select("group_id", "id", F.lit(1).alias("version"), F.lit(None).cast("int").alias("superseded_by"))
    hit = old.where("id % 10 = 0").select("group_id").distinct()
    places = settle(old.join(hit, "group_id", "left_semi").select("id"), "places")
    return G.apply_recipe(members, new.join(places, "id", "left_semi"), places, 2).withColumn("superseded_by", F.coalesce("superseded_by", F.lit(0)))


@CORE.query(
    "final_groups",
    f"""WITH RECURSIVE {SQL_PARTS}
SELECT channel_id, id, part, CAST(p - head AS BIGINT) AS position, false AS is_context FROM h
UNION ALL SELECT b.channel_id, b.id, a.part, CAST(b.p - a.p AS BIGINT), true FROM h a JOIN h b ON b.key = a.key AND b.p BETWEEN a.p - 3 AND a.p - 1 JOIN h z ON z.key = a.key AND z.p = a.p - 1 AND z.head = b.head WHERE a.p = a.head AND a.p > 0""",
)
def final_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges as they are stored: small groups folded into a neighbour, large ones split."""
    return exchange_parts(spark, sf_dir)


@CORE.query(
    "session_hours",
    f"WITH {SQL_POOL}, s AS {sql_quiet(30)} SELECT channel_id, min(us) // 3600000000 AS hour, count(*) AS n FROM s GROUP BY channel_id, group_no",
)
def session_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by Spark's session_window, as streams use it."""
    p = pool(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    # session_window ends where the gap is over and parts at exactly the gap: one microsecond more keeps it together.
    s = p.groupBy("channel_id", F.session_window("ts", "30 minutes 1 microsecond").alias("w")).agg(F.count("*").alias("n"), F.min("us").alias("us"))
    return s.select("channel_id", F.expr("us div 3600000000").alias("hour"), "n")
