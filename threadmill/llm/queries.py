"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..storage import settle, table
from . import leaks, packing, pii, subjects, terms, threads, vectors

llm = Registry()

# ---- 1: conversations

_CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, author_id DESC) AS rn FROM messages) WHERE rn = 1 AND deleted_at IS NULL)"""
_PLACED = f"""WITH RECURSIVE {_CURRENT},
walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM cur WHERE thread_id IS NULL AND reply_to_id IS NULL
  UNION ALL
  SELECT c.id, w.root, w.depth + 1 FROM walk w JOIN cur c ON c.reply_to_id = w.id WHERE c.thread_id IS NULL
),
placed AS (
  SELECT id, thread_id AS conversation_id, author_id, author_is_bot, content, position, reply_to_id, thread_id FROM cur WHERE thread_id IS NOT NULL
  UNION ALL
  SELECT c.id, w.root, author_id, author_is_bot, content, position, reply_to_id, thread_id FROM cur c JOIN walk w ON w.id = c.id
)"""


@llm.query(
    "p1_found",
    _PLACED
    + """, kept AS (
  SELECT conversation_id, max(CASE WHEN position = 0 THEN author_id END) AS opener FROM placed
  GROUP BY conversation_id
  HAVING count(*) >= 2 AND count(position) = count(*) AND count(DISTINCT position) = count(*) AND min(position) = 0 AND max(position) = count(*) - 1
     AND count(DISTINCT CASE WHEN regexp_replace(content, '[\\s\\x{85}\\x{A0}\\x{200B}]', '', 'g') <> '' THEN author_id END) >= 2
     AND NOT bool_or(reply_to_id IS NOT NULL AND (reply_to_id = id OR reply_to_id NOT IN (SELECT id FROM cur)))
)
SELECT p.conversation_id, p.id AS message_id, CAST(p.position AS BIGINT) AS turn,
  CASE WHEN author_is_bot THEN 'bot' WHEN author_id = opener THEN 'opener' ELSE 'replier' END AS speaker_role
FROM placed p JOIN kept k ON k.conversation_id = p.conversation_id""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.conversations(table(spark, sf_dir, "messages"))


@llm.query(
    "p1_states",
    _PLACED
    + """SELECT c.id AS message_id, CASE WHEN c.thread_id IS NOT NULL THEN c.thread_id ELSE w.root END AS conversation_id,
  CASE WHEN c.thread_id IS NOT NULL THEN 'thread' WHEN c.reply_to_id IS NULL THEN 'root' WHEN w.root IS NOT NULL THEN 'reply' ELSE 'broken' END AS state
FROM cur c LEFT JOIN walk w ON w.id = c.id""",
)
def p1_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = threads.placed_messages(table(spark, sf_dir, "messages"))
    state = F.when(F.col("state").isin("orphan", "cycle"), "broken").otherwise(F.col("state"))
    return p.select(F.col("id").alias("message_id"), "conversation_id", state.alias("state"))


@llm.query(
    "p1_paths",
    _PLACED
    + """, node AS (SELECT id, root, depth FROM walk), up AS (SELECT n.id, c.reply_to_id AS parent FROM node n JOIN cur c ON c.id = n.id WHERE n.depth > 0),
leaf AS (SELECT * FROM node WHERE id NOT IN (SELECT parent FROM up)),
path AS (SELECT id AS leaf_id, root AS conversation_id, depth AS step, id AS message_id FROM leaf
  UNION ALL SELECT leaf_id, conversation_id, step - 1, up.parent FROM path JOIN up ON up.id = path.message_id)
SELECT * FROM path""",
)
def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.root_to_leaf_paths(table(spark, sf_dir, "messages"))


# ---- 4: terms

_TERMS = r"""WITH seen AS (SELECT DISTINCT lower(regexp_replace(term, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS term, exchange_id, term AS spelled, coalesce(tech, 0) AS tech, coalesce("off", 0) AS off_
  FROM mined_terms WHERE coalesce(tech, 0) <> 0 OR coalesce("off", 0) <> 0),
totals AS (SELECT term, sum(tech) AS tech, sum(off_) AS off_, count(DISTINCT exchange_id) AS n FROM seen WHERE term <> '' GROUP BY term),
banded AS (SELECT *, CASE WHEN n < 3 THEN 'rare' WHEN n > 0.08 * (SELECT count(DISTINCT exchange_id) FROM mined_terms) THEN 'common' END AS band FROM totals)
"""


@llm.query("p4_found", _TERMS + "SELECT term, band FROM banded WHERE band IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked_terms(table(spark, sf_dir, "mined_terms"))


@llm.query("p4_terms", _TERMS + 'SELECT term, CAST(tech AS BIGINT) AS tech, CAST(off_ AS BIGINT) AS "off", n AS n_exchanges, coalesce(band, \'useful\') AS band FROM banded')
def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_totals(table(spark, sf_dir, "mined_terms")).withColumn("band", F.coalesce("band", F.lit("useful")))


# ---- 5: similar vectors


@llm.query(
    "p5_found",
    """WITH v AS (SELECT exchange_id AS id, max(vector) AS v FROM exchange_vectors
  WHERE revision = 'r2' AND vector IS NOT NULL AND list_sum(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY exchange_id),
n AS (SELECT id, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM v),
s AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS rn FROM n a JOIN n b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS exchange_id_a, greatest(a, b) AS exchange_id_b FROM s WHERE rn <= 3""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.comparable(table(spark, sf_dir, "exchange_vectors"), "exchange_id", "vector", "r2")
    return vectors.similar_pairs(v, 3).toDF("exchange_id_a", "exchange_id_b")


# ---- 9: leaked evaluation items


@llm.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


@llm.query("p9_cleaned")
def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# ---- 8: containers


@llm.query("p8_assignment")
def p8_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@llm.query("p8_buckets")
def p8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches strictly inside each bucket."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), mixed=False)


@llm.query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = packing.pack_documents(table(spark, sf_dir, "documents")).where(F.col("container_id").isNotNull())
    return a.groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), (F.lit(2048) - F.sum("n_tokens")).alias("room"))


# ---- 6: personal information


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = table(spark, sf_dir, "source_messages"), table(spark, sf_dir, "messages")
    known = pii.author_names((s, "author_name", "author_id"), (m, "author_name_at_time", "author_id"))
    return pii.find(s, known)


@llm.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(spark, sf_dir).select("message_id", F.explode("kinds").alias("kind")).distinct()


@llm.query("p6_redacted")
def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(spark, sf_dir).select("message_id", "n_finds", "redacted")


# ---- 10: subjects


def _tables10(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")]


@llm.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(*_tables10(spark, sf_dir))


@llm.query("p10_composition")
def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subjects.subject_shares(*_tables10(spark, sf_dir)).where(F.col("share") >= subjects.SHARE)
    return s.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_about").alias("n_sentences"))
