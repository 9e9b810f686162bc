"""Filters, joins, aggregates, windows and set operations over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..functions.times import micros
from ..operators import relational as R
from ..operators.current import latest_by
from ..storage import table
from .base import SQL_CUR, SQL_EM, SQL_LATEST_CHANNELS, channels, current, exchange_messages
from .registry import CORE

# ---- scans and ingestion


@CORE.query("light_messages", "SELECT id, channel_id, author_id, thread_id, epoch_us(created_at) AS us FROM messages WHERE deleted_at IS NULL AND created_at >= TIMESTAMP '2024-04-01'")
def light_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "messages").where("deleted_at IS NULL AND created_at >= TIMESTAMP_NTZ '2024-04-01 00:00:00'")
    return m.select("id", "channel_id", "author_id", "thread_id", micros(m, "created_at").alias("us"))


@CORE.query(
    "normalized_messages",
    """SELECT id, max(channel_id) AS channel_id, count(*) AS deliveries, arg_max(coalesce(content, ''), (coalesce(edited_at, TIMESTAMP '1970-01-01'), delivered_at, coalesce(content, ''))) AS content
FROM source_messages WHERE NOT is_system AND NOT author_is_bot GROUP BY id""",
)
def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "source_messages").where("NOT is_system AND NOT author_is_bot").withColumn("content", F.coalesce("content", F.lit("")))
    newest = latest_by(s, ["id"], ["edited_at", "delivered_at", "content"], ["content"])
    n = s.groupBy("id").agg(F.max("channel_id").alias("channel_id"), F.count("*").alias("deliveries"))
    return n.join(newest, "id")


@CORE.query(
    "message_revisions",
    """WITH d AS (SELECT DISTINCT id, delivered_at, content FROM source_messages WHERE content IS NOT NULL),
p AS (SELECT *, lag(content) OVER (PARTITION BY id ORDER BY delivered_at, content) AS before FROM d)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY delivered_at, content) AS revision, content FROM p WHERE before IS NULL OR before <> content""",
)
def message_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "source_messages").where("content IS NOT NULL").select("id", "delivered_at", "content").distinct()
    w = Window.partitionBy("id").orderBy("delivered_at", "content")
    d = d.withColumn("before", F.lag("content").over(w)).where("before IS NULL OR before <> content")
    return d.select("id", F.row_number().over(w).cast("long").alias("revision"), "content")


@CORE.query("first_deletion", "SELECT message_id, epoch_us(min(deleted_at)) AS deleted_us, count(*) AS n FROM message_changes WHERE op = 'delete' AND deleted_at IS NOT NULL GROUP BY message_id")
def first_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "message_changes").where("op = 'delete' AND deleted_at IS NOT NULL")
    g = c.groupBy("message_id").agg(F.min("deleted_at").alias("deleted_at"), F.count("*").alias("n"))
    return g.select("message_id", micros(g, "deleted_at").alias("deleted_us"), "n")


@CORE.query("channel_upsert", f"WITH {SQL_LATEST_CHANNELS} SELECT id, coalesce(parent_id, 0) AS parent_id, name, kind, coalesce(mark, 0) AS mark FROM chan")
def channel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).select("id", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), "name", "kind", F.coalesce("mark", F.lit(0)).alias("mark"))


_NAMED = f"WITH {SQL_CUR}, {SQL_LATEST_CHANNELS}, named AS (SELECT c.id, lower(coalesce(p.name, c.name)) AS top, lower(c.name) AS own FROM chan c LEFT JOIN chan p ON p.id = c.parent_id)"


@CORE.query("channel_filter", _NAMED + " SELECT id FROM cur WHERE coalesce(thread_id, channel_id) IN (SELECT id FROM named WHERE top LIKE '%m%') AND coalesce(thread_id, channel_id) NOT IN (SELECT id FROM named WHERE own LIKE '%z%' OR top LIKE '%z%')")
def channel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in channels included by name and not excluded by name; threads take their channel's name too; exclusion wins."""
    c = channels(spark, sf_dir)
    p = c.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    named = c.join(p, F.col("parent_id") == F.col("p_id"), "left").select(F.col("id").alias("c_id"), F.lower(F.coalesce("p_name", "name")).alias("top"), F.lower("name").alias("own"))
    m = current(spark, sf_dir, "channel_id", "thread_id").select("id", F.coalesce("thread_id", "channel_id").alias("place"))
    kept = m.join(named.where(F.col("top").contains("m")), F.col("place") == F.col("c_id"), "left_semi")
    return kept.join(named.where(F.col("own").contains("z") | F.col("top").contains("z")), F.col("place") == F.col("c_id"), "left_anti").select("id")


@CORE.query("channel_allowlist", f"WITH {SQL_LATEST_CHANNELS}, ok AS (SELECT id FROM chan WHERE kind = 'text' AND id % 2 = 0) SELECT id, name FROM chan WHERE id IN (SELECT id FROM ok) OR parent_id IN (SELECT id FROM ok)")
def channel_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = channels(spark, sf_dir)
    ok = c.where("kind = 'text' AND id % 2 = 0").select(F.col("id").alias("ok_id"))
    by = lambda k: c.join(ok, F.col(k) == F.col("ok_id"), "left_semi")
    return by("id").unionByName(by("parent_id")).select("id", "name").distinct()


@CORE.query(
    "shareable_text",
    f"WITH {SQL_EM}, opted AS (SELECT DISTINCT author_id FROM cur WHERE author_id % 7 = 0) SELECT xid, count(*) AS n_text FROM em WHERE author_id NOT IN (SELECT author_id FROM opted) AND regexp_replace(content, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') <> '' GROUP BY xid HAVING count(*) >= 3",
)
def shareable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir)
    opted = current(spark, sf_dir, "author_id", "content").where("author_id % 7 = 0").select("author_id").distinct()
    return em.join(opted, "author_id", "left_anti").where(T.has_text(F.col("content"))).groupBy("xid").agg(F.count("*").alias("n_text")).where("n_text >= 3")


@CORE.query(
    "bulk_rules",
    f"""WITH {SQL_CUR}, c AS (SELECT *, coalesce(content, '') AS c FROM cur), r AS (
SELECT 'contains' AS rule, id FROM c WHERE contains(lower(c), 'morning') UNION ALL SELECT 'exact', id FROM c WHERE c = 'Lol same here' UNION ALL SELECT 'author', id FROM c WHERE lower(author_name_at_time) = 'milo deligan'
UNION ALL SELECT 'shorter_than', id FROM c WHERE length(c) < 12 UNION ALL SELECT 'regex', id FROM c WHERE regexp_matches(c, '(?i)^welcome')) SELECT rule, count(*) AS n, min(id) AS first_id FROM r GROUP BY rule""",
)
def bulk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("content", F.lit(""))
    rules = {"contains": F.lower(c).contains("morning"), "exact": c == "Lol same here", "author": F.lower("author_name_at_time") == "milo deligan", "shorter_than": F.length(c) < 12, "regex": c.rlike("(?i)^welcome")}
    hit = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return current(spark, sf_dir, "author_name_at_time", "content").select("id", F.explode(hit).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# ---- joins


@CORE.query(
    "version_active_at",
    "WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click') SELECT e.event_id, coalesce(v.value, -1) AS value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts",
)
def version_active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("us", micros(e, "ts"))
    probes = e.where("event_type = 'error'").select("user_id", "event_id", "us")
    versions = e.where("event_type = 'click'").select("user_id", F.col("us").alias("since"), F.col("event_id").alias("no"), "value")
    return R.as_of(probes, versions, ["user_id"], "us", "since", "value", "no").select("event_id", F.coalesce("value", F.lit(-1.0)).alias("value"))


@CORE.query(
    "all_sources_deleted",
    f"WITH {SQL_CUR} SELECT coalesce(thread_id, channel_id) AS place, author_id, count(*) AS n FROM cur GROUP BY 1, 2 HAVING bool_and(deleted_at IS NOT NULL)",
)
def all_sources_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = current(spark, sf_dir, "channel_id", "author_id", "thread_id", "deleted_at").select(F.struct(F.coalesce("thread_id", "channel_id").alias("place"), "author_id").alias("k"), "deleted_at")
    return R.universal(m, "k", F.col("deleted_at").isNotNull()).select("k.place", "k.author_id", "n")


@CORE.query(
    "changed_versions",
    f"WITH {SQL_CUR}, s AS (SELECT id, max(content) AS content FROM source_messages WHERE NOT is_system GROUP BY id) SELECT s.id FROM s JOIN cur c ON c.id = s.id WHERE s.content IS DISTINCT FROM c.content",
)
def changed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe inequality between what was delivered and what is stored."""
    s = table(spark, sf_dir, "source_messages").where("NOT is_system").groupBy("id").agg(F.max("content").alias("delivered"))
    return s.join(current(spark, sf_dir, "content").select("id", "content"), "id").where(~F.col("delivered").eqNullSafe(F.col("content"))).select("id")


@CORE.query(
    "message_places",
    _NAMED + " SELECT c.id, coalesce(n.own, '') AS own, coalesce(n.top, '') AS top FROM cur c LEFT JOIN named n ON n.id = coalesce(c.thread_id, c.channel_id)",
)
def message_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = channels(spark, sf_dir)
    p = c.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    named = c.join(p, F.col("parent_id") == F.col("p_id"), "left").select(F.col("id").alias("c_id"), F.lower(F.coalesce("p_name", "name")).alias("top"), F.lower("name").alias("own"))
    m = current(spark, sf_dir, "channel_id", "thread_id").select("id", F.coalesce("thread_id", "channel_id").alias("place"))
    return m.join(named, F.col("place") == F.col("c_id"), "left").select("id", F.coalesce("own", F.lit("")).alias("own"), F.coalesce("top", F.lit("")).alias("top"))


# ---- aggregates


@CORE.query(
    "table_status",
    "SELECT 'messages' AS name, count(*) AS n, count(DISTINCT id) AS keys FROM messages UNION ALL SELECT 'source_messages', count(*), count(DISTINCT id) FROM source_messages UNION ALL SELECT 'channels', count(*), count(DISTINCT id) FROM channels UNION ALL SELECT 'changes', count(*), count(DISTINCT message_id) FROM message_changes",
)
def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = None
    for name, t, k in (("messages", "messages", "id"), ("source_messages", "source_messages", "id"), ("channels", "channels", "id"), ("changes", "message_changes", "message_id")):
        one = table(spark, sf_dir, t).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(k).alias("keys"))
        every = one if every is None else every.unionByName(one)
    return every


@CORE.query(
    "archived_subjects",
    """WITH latest AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
SELECT user_id FROM latest GROUP BY user_id HAVING sum(CASE WHEN event_type = 'error' AND value > 20 THEN 1 WHEN event_type = 'click' AND value < 1 THEN 1 ELSE 0 END) = 0""",
)
def archived_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects whose latest scores of all scorers rule nothing out."""
    latest = latest_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    out = ((F.col("event_type") == "error") & (F.col("value") > 20)) | ((F.col("event_type") == "click") & (F.col("value") < 1))
    return latest.groupBy("user_id").agg(F.sum(F.when(out, 1).otherwise(0)).alias("ruled_out")).where("ruled_out = 0").select("user_id")


@CORE.query("exchange_participants", f"WITH {SQL_EM} SELECT xid, count(DISTINCT author_id) AS authors, string_agg(content, ' / ' ORDER BY position) AS joined FROM em GROUP BY xid")
def exchange_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange_messages(spark, sf_dir).groupBy("xid").agg(F.count_distinct("author_id").alias("authors"), F.expr("listagg(content, ' / ') WITHIN GROUP (ORDER BY position)").alias("joined"))


@CORE.query("top_channels", f"WITH {SQL_CUR} SELECT channel_id, count(*) AS n FROM cur GROUP BY channel_id ORDER BY n DESC, channel_id LIMIT 10")
def top_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, "channel_id").groupBy("channel_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel_id").limit(10)


@CORE.query("score_histogram", "WITH s AS (SELECT least(9, CAST(floor(value / 10) AS BIGINT)) AS b FROM events) SELECT b AS bucket, count(*) AS n, (b / 10)::DECIMAL(2,1)::VARCHAR || '-' || ((b + 1) / 10)::DECIMAL(2,1)::VARCHAR AS label FROM s GROUP BY b")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.least(F.lit(9), F.floor(F.col("value") / 10).cast("long"))
    g = table(spark, sf_dir, "events").groupBy(b.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    part = lambda x: (x / 10).cast("decimal(2,1)").cast("string")
    return g.withColumn("label", F.concat_ws("-", part(F.col("bucket")), part(F.col("bucket") + 1)))


@CORE.query(
    "size_buckets",
    f"WITH {SQL_EM}, s AS (SELECT xid, count(*) AS n FROM em GROUP BY xid) SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 15 THEN '6-15' WHEN n <= 49 THEN '16-49' ELSE 'cap' END AS size, count(*) AS exchanges, CAST(sum(n) AS BIGINT) AS messages FROM s GROUP BY 1",
)
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.count("*").alias("n"))
    b = stats.bucket(F.col("n"), [(1, "1"), (2, "2"), (5, "3-5"), (15, "6-15"), (49, "16-49")], "cap")
    return s.groupBy(b.alias("size")).agg(F.count("*").alias("exchanges"), F.sum("n").alias("messages"))


@CORE.query("nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@CORE.query("index_quantile", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS quantile FROM r WHERE i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))")
def index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index_quantile(table(spark, sf_dir, "events"), ["event_type"], "value", F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))


@CORE.query(
    "exclusive_quantiles",
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS m FROM events), k AS (SELECT unnest(range(1, 10)) AS i),
c AS (SELECT DISTINCT k.i, m, (m + 1) * k.i / 10.0 AS r FROM k, r), j AS (SELECT i, r, greatest(1, least(CAST(floor(r) AS BIGINT), m - 1)) AS j FROM c)
SELECT j.i, round(a.value + (b.value - a.value) * (j.r - j.j), 6) AS cut FROM j JOIN r a ON a.i = j.j JOIN r b ON b.i = j.j + 1""",
)
def exclusive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclusive_quantiles(table(spark, sf_dir, "events"), "value", 10).withColumn("cut", F.round("cut", 6))


@CORE.query(
    "verdict_pivot",
    "SELECT subject, count_if(labeled_by = 'human') AS human, count_if(labeled_by = 'rule') AS rule FROM subject_labels WHERE subject IS NOT NULL GROUP BY subject",
)
def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "subject_labels").where("subject IS NOT NULL").groupBy("subject").pivot("labeled_by", ["human", "rule"]).count()
    return p.select("subject", F.coalesce("human", F.lit(0)).alias("human"), F.coalesce("rule", F.lit(0)).alias("rule"))


@CORE.query(
    "effective_labels",
    "SELECT doc_id, arg_min(subject, (CASE labeled_by WHEN 'human' THEN 0 ELSE 1 END, subject)) AS label, bool_or(labeled_by = 'human') AS by_human FROM subject_labels WHERE subject IS NOT NULL GROUP BY doc_id",
)
def effective_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A human's label wins over a rule's; ties go to the first by name."""
    l = table(spark, sf_dir, "subject_labels").where("subject IS NOT NULL")
    rank = F.struct(F.when(F.col("labeled_by") == "human", 0).otherwise(1), F.col("subject"))
    return l.groupBy("doc_id").agg(F.min_by("subject", rank).alias("label"), F.max(F.col("labeled_by") == "human").alias("by_human"))


@CORE.query("label_replay", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) IN ('click', 'view')")
def label_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("label"))
    return R.latest_state(e, "user_id", ["ts", "event_id"], "label", ("click", "view"))


@CORE.query(
    "self_consistency",
    """WITH e AS (SELECT user_id, event_type, value, event_id, first_value(event_type) OVER w AS f_label, first_value(value) OVER w AS f_ref FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, f_label, arg_max(event_type, event_id) AS last_label FROM e WHERE value <> f_ref GROUP BY ALL) SELECT count(*) AS repeated, count_if(f_label = last_label) AS agreed FROM l""",
)
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type", "value")).alias("f")).select("user_id", F.col("f.event_type").alias("f_label"), F.col("f.value").alias("f_ref"))
    later = e.join(first, "user_id").where("value <> f_ref").groupBy("user_id", "f_label").agg(F.max_by("event_type", "event_id").alias("last_label"))
    return later.agg(F.count("*").alias("repeated"), F.count_if(F.col("f_label") == F.col("last_label")).alias("agreed"))


@CORE.query(
    "channel_label_report",
    f"WITH {SQL_EM}, x AS (SELECT xid, min(channel_id) AS channel_id, xid % 3 AS v FROM em GROUP BY xid) SELECT channel_id, count(*) AS exchanges, count_if(v = 0) AS relevant, count_if(v = 1) AS irrelevant, round(100.0 * count_if(v = 1) / count_if(v < 2), 4) AS pct_irrelevant FROM x GROUP BY channel_id HAVING count_if(v < 2) >= 5",
)
def channel_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.min("channel_id").alias("channel_id")).withColumn("v", F.col("xid") % 3)
    g = x.groupBy("channel_id").agg(F.count("*").alias("exchanges"), F.count_if(F.col("v") == 0).alias("relevant"), F.count_if(F.col("v") == 1).alias("irrelevant"))
    g = g.where(F.col("relevant") + F.col("irrelevant") >= 5)
    return g.withColumn("pct_irrelevant", F.round(100.0 * F.col("irrelevant") / (F.col("relevant") + F.col("irrelevant")), 4))


@CORE.query(
    "channel_priors",
    f"WITH {SQL_EM}, x AS (SELECT xid, min(channel_id) AS channel_id, least(1.0, count(*) / 20.0) AS raw FROM em GROUP BY xid), g AS (SELECT avg(raw) AS g FROM x), c AS (SELECT channel_id, avg(raw) AS c FROM x GROUP BY channel_id) SELECT xid, round(greatest(0, least(1, raw + round(greatest(-0.1, least(0.1, 0.3 * (c - g))), 4))), 4) AS adjusted FROM x JOIN c USING (channel_id), g",
)
def channel_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.min("channel_id").alias("channel_id"), F.least(F.lit(1.0), F.count("*") / 20.0).alias("raw"))
    c, g = x.groupBy("channel_id").agg(F.avg("raw").alias("c")), x.agg(F.avg("raw").alias("g"))
    delta = F.round(stats.clip(0.3 * (F.col("c") - F.col("g")), -0.1, 0.1), 4)
    j = x.join(c, "channel_id").join(F.broadcast(g), F.lit(True))
    return j.select("xid", F.round(stats.clip(F.col("raw") + delta, 0.0, 1.0), 4).alias("adjusted"))


@CORE.query(
    "throughput",
    "WITH n AS (SELECT max(ts) AS t FROM events), w AS (SELECT event_type, count(*) AS n FROM events, n WHERE ts > t - INTERVAL 6 HOUR GROUP BY event_type) SELECT event_type, n, round(n / 6.0, 6) AS per_hour, round(1000 / (n / 6.0), 6) AS eta_hours FROM w",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("us", micros(e, "ts"))
    t = e.agg((F.max("us") - 6 * 3_600_000_000).alias("t"))
    w = e.join(F.broadcast(t), F.col("us") > F.col("t")).groupBy("event_type").agg(F.count("*").alias("n"))
    return w.select("event_type", "n", F.round(F.col("n") / 6.0, 6).alias("per_hour"), F.round(1000 / (F.col("n") / 6.0), 6).alias("eta_hours"))


@CORE.query(
    "speaker_stats",
    f"WITH {SQL_CUR}, a AS (SELECT author_id, author_name_at_time AS name, count(*) AS n FROM cur GROUP BY ALL) SELECT author_id, arg_min(name, (-n, name)) AS label, CAST(sum(n) AS BIGINT) AS messages, count(*) AS names FROM a GROUP BY author_id",
)
def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = current(spark, sf_dir, "author_id", "author_name_at_time").groupBy("author_id", F.col("author_name_at_time").alias("name")).agg(F.count("*").alias("n"))
    return a.groupBy("author_id").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("label"), F.sum("n").alias("messages"), F.count("*").alias("names"))


# ---- windows


@CORE.query("message_gaps", f"WITH {SQL_EM} SELECT xid, position, us - lag(us, 1, us) OVER (PARTITION BY xid ORDER BY position) AS gap FROM em")
def message_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("xid").orderBy("position")
    return exchange_messages(spark, sf_dir).select("xid", "position", (F.col("us") - F.coalesce(F.lag("us").over(w), F.col("us"))).alias("gap"))


@CORE.query(
    "position_features",
    f"""WITH {SQL_EM}, n AS (SELECT *, count(*) OVER (PARTITION BY xid) AS size, lag(author_id) OVER w AS pa, lag(content) OVER w AS pc, lead(id) OVER w AS nx FROM em WINDOW w AS (PARTITION BY xid ORDER BY position))
SELECT id, CASE WHEN size <= 1 OR position <= 0 THEN 'POS_first' WHEN position >= size - 1 THEN 'POS_last' WHEN position <= greatest(1, size // 3) THEN 'POS_early' ELSE 'POS_middle' END AS bucket,
 coalesce(pa = author_id, false) AS same_author, coalesce(regexp_matches(pc, '\\?\\s*$'), false) AS after_question, coalesce(nx, 0) AS next_id FROM n""".replace("\\\\", "\\"),
)
def position_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.neighbours(exchange_messages(spark, sf_dir))
    return n.select("id", R.position_bucket(F.col("position"), F.col("size")).alias("bucket"), "same_author", "after_question", F.coalesce("next_id", F.lit(0)).alias("next_id"))


@CORE.query(
    "answered_questions",
    f"WITH {SQL_EM} SELECT DISTINCT q.xid FROM em q JOIN em a ON a.xid = q.xid AND a.position > q.position AND a.author_id <> q.author_id WHERE contains(q.content, '?') AND length(trim(a.content)) >= 40",
)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.answered(exchange_messages(spark, sf_dir))


@CORE.query("last_snippets", f"WITH {SQL_EM}, r AS (SELECT *, row_number() OVER (PARTITION BY xid ORDER BY position DESC) AS place FROM em WHERE content <> '') SELECT xid, place, id FROM r WHERE place <= 2")
def last_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = exchange_messages(spark, sf_dir).where("content <> ''")
    return R.top_per_key(m, ["xid"], [F.desc("position")], 2).select("xid", F.col("place").cast("long").alias("place"), "id")


@CORE.query(
    "interleaved",
    f"WITH {SQL_EM}, r AS (SELECT id, position, min(us) OVER (PARTITION BY xid) AS seen, xid FROM em) SELECT id, row_number() OVER (ORDER BY position, seen, xid) AS turn FROM r",
)
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per exchange and pass, exchanges in order of first sight.

    Numbered without one global window: places before a pass are sums of the
    passes' sizes, so only one pass is ever sorted at once.
    """
    m = exchange_messages(spark, sf_dir)
    seen = m.groupBy("xid").agg(F.min("us").alias("seen"))
    sizes = m.groupBy("position").agg(F.count("*").alias("size"))
    before = sizes.select("position", F.coalesce(F.sum("size").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    r = m.join(seen, "xid").withColumn("rn", F.row_number().over(Window.partitionBy("position").orderBy("seen", "xid")))
    return r.join(before, "position").select("id", (F.col("before") + F.col("rn")).alias("turn"))


@CORE.query(
    "topic_growth",
    "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IS NOT NULL) SELECT source, min(doc_id) AS first, coalesce(min(doc_id) FILTER (WHERE rn = 5), 0) AS reached, count(*) AS n FROM r GROUP BY source",
)
def topic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.growth(table(spark, sf_dir, "documents").where("source IS NOT NULL"), "source", ["doc_id"], 5)
    return g.withColumn("reached", F.coalesce("reached", F.lit(0)))


@CORE.query(
    "largest_remainder",
    "WITH s AS (SELECT coalesce(source, '') AS source, count(*) AS size FROM documents GROUP BY 1), e AS (SELECT *, size * 100 / sum(size) OVER () AS x FROM s), f AS (SELECT *, floor(x) AS b, round(x - floor(x), 9) AS fr FROM e), r AS (SELECT *, row_number() OVER (ORDER BY fr DESC, source) AS rk, 100 - sum(b) OVER () AS rest FROM f) SELECT source, CAST(b + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS places FROM r",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("size"))
    return R.largest_remainder(s, "source", "size", 100)


@CORE.query(
    "round_robin_sample",
    "WITH r AS (SELECT coalesce(source, '') AS source, doc_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY sha256('seed:' || doc_id)) AS pass FROM documents) SELECT source, doc_id, pass FROM r ORDER BY pass, source LIMIT 60",
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id")
    return R.round_robin(d, "source", [stats.hash_order("seed", F.col("doc_id"))], 60).withColumn("pass", F.col("pass").cast("long"))


@CORE.query("unique_slugs", "WITH n AS (SELECT name, count(*) AS w, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM channels GROUP BY name), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY w DESC, name) AS rn FROM n) SELECT name, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS slug FROM r")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "channels").groupBy("name").agg(F.count("*").alias("w")).withColumn("base", T.slug(F.col("name")))
    r = n.withColumn("rn", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("w"), "name")))
    return r.select("name", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "rn")).alias("slug"))


# ---- set operations

_IDS = "WITH a AS (SELECT id FROM messages WHERE deleted_at IS NULL), b AS (SELECT id FROM source_messages WHERE NOT is_system) "


@CORE.query("set_operations", _IDS + "SELECT 'both' AS side, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'archive', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'source', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT id FROM a UNION ALL SELECT id FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes from one pass: which sides every id occurs on."""
    a = table(spark, sf_dir, "messages").where("deleted_at IS NULL").select("id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf_dir, "source_messages").where("NOT is_system").select("id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = a.unionByName(b).groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    one = g.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"), F.count_if(F.col("b") == 0).alias("archive"), F.count_if(F.col("a") == 0).alias("source"), F.count("*").alias("any"), F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(0)).alias("all"))
    return one.select(F.expr("stack(5, 'both', both, 'archive', archive, 'source', source, 'any', any, 'all', all) AS (side, n)"))
