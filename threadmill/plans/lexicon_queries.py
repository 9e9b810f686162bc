"""Lexicon hits, rule names and message features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as L
from ..operators import search as S
from ..storage import settle, table
from .base import SQL_EM, exchange_messages
from .classify_queries import _SCORE, rule_score
from .registry import CORE
from .text_queries import _FACTS, _FLAGS, _MINED, SQL_WORDS

#: Stand-in gazetteer of this archive's invented content.
GAZETTEER = {"machine": r"\b[a-z]{4,} [0-9]{2,3}0\b", "prompt": r"[a-z]+@[a-z]+:", "version": r"[0-9]+\.[0-9]+\.[0-9]+"}
SHARES = {"greeting": r"^[^\p{L}\p{N}_]*(?:hi|hello|hey|good (?:morning|night|evening)( everyone)?|welcome|thanks?|thx)[^\p{L}\p{N}_]*$", "link_only": r"^<?https?://\S+>?$", "laugh": r"^[^\p{L}\p{N}_]*(?:lol+|lmao+|same|real)( same here)?[^\p{L}\p{N}_]*$"}
_URL = r"https?://[^\s<>()]+"
_HOST = r"string_split(regexp_replace(regexp_extract(t, '^[a-z]+://([^/?#:]*)', 1), '(^|\.)www\.', '\1'), '.')"
_LEX_TOKENS = rf"""list_filter(list_transform(regexp_extract_all(translate(lower(content), '’', ''''), '{_URL}|[\p{{L}}\p{{N}}_/][\p{{L}}\p{{N}}_''./+-]*'), lambda t: CASE WHEN regexp_matches(t, '^https?://')
  THEN CASE WHEN len({_HOST}) >= 3 AND {_HOST}[-2] IN ('co','com','org','net','ac','gov','edu') THEN {_HOST}[-3] WHEN len({_HOST}) >= 2 THEN {_HOST}[-2] ELSE {_HOST}[1] END ELSE regexp_replace(t, '[.,!?;:)''"-]+$', '') END),
  lambda t: length(t) <= 40 AND regexp_matches(t, '[\p{{L}}\p{{N}}]'))"""
_LEXICON = "lex AS (SELECT word FROM (SELECT unnest(string_split(term, ' ')) AS word, tech, off_ FROM t) GROUP BY word HAVING sum(tech) >= 5 AND sum(tech) > 2 * sum(off_))"
_HITS = f"""{_MINED}, {_LEXICON}, {SQL_EM},
tok AS (SELECT DISTINCT id, unnest({_LEX_TOKENS}) AS word FROM em),
hit AS (SELECT id, word FROM tok WHERE word IN (SELECT word FROM lex) UNION SELECT id, left(word, -1) FROM tok WHERE suffix(word, 's') AND word NOT IN (SELECT word FROM lex) AND left(word, -1) IN (SELECT word FROM lex)),
hits AS (SELECT em.id, list_concat(coalesce((SELECT list(word ORDER BY word) FROM hit WHERE hit.id = em.id), []), list_filter([{', '.join(f"CASE WHEN regexp_matches(content, '(?i){p}') THEN 'gaz:{n}' END" for n, p in GAZETTEER.items())}], lambda x: x IS NOT NULL)) AS hits FROM em)"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of mined terms that speak for the tech side: term."""
    t = table(spark, sf_dir, "mined_terms").select(F.lower(F.trim("term")).alias("term"), F.coalesce("tech", F.lit(0)).alias("tech"), F.coalesce("off", F.lit(0)).alias("off")).where("term <> ''")
    w = t.groupBy("term").agg(F.sum("tech").alias("tech"), F.sum("off").alias("off")).select(F.explode(F.split("term", " ")).alias("term"), "tech", "off")
    return w.groupBy("term").agg(F.sum("tech").alias("tech"), F.sum("off").alias("off")).where("tech >= 5 AND tech > 2 * off").select("term")


@CORE.query("lexicon_tokens", f"WITH {SQL_EM} SELECT id, {_LEX_TOKENS} AS words FROM em")
def lexicon_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange_messages(spark, sf_dir).select("id", L.lexicon_tokens(F.col("content")).alias("words"))


@CORE.query("message_hits", f"{_HITS} SELECT id, array_to_string(hits, ' ') AS hits FROM hits")
def message_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.message_hits(exchange_messages(spark, sf_dir).select("id", "content"), lexicon(spark, sf_dir), GAZETTEER).select("id", F.array_join("hits", " ").alias("hits"))


@CORE.query("lexicon_scores", f"{_HITS} SELECT xid, round(count_if(len(hits) > 0) / count(*), 9) AS share, CAST(sum(len(hits)) AS BIGINT) AS hits, count(*) AS messages FROM em JOIN hits USING (id) GROUP BY xid")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir)
    s = L.lexicon_scores(L.message_hits(em.select("id", "content"), lexicon(spark, sf_dir), GAZETTEER), em.select("id", "xid"), "xid")
    return s.withColumn("share", F.round("share", 9))


_TRIM = r"regexp_replace(content, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"
_NAMES = (
    _SCORE
    + ", gz AS (SELECT xid, count(*) AS n, count_if(bot) AS bots, sum(length(content)) + count(*) - 1 AS chars, "
    + ", ".join([*(f"bool_or(regexp_matches(content, '(?i){p}')) AS t_{n}" for n, p in GAZETTEER.items()), *(f"count_if(regexp_matches({_TRIM}, '(?i){p}')) AS s_{n}" for n, p in SHARES.items())])
    + " FROM em GROUP BY xid), nm AS (SELECT xid, list_sort(list_distinct(list_concat(list_filter(["
    + ", ".join([*(f"CASE WHEN t_{n} THEN 'gaz_{n}' END" for n in GAZETTEER), *(f"CASE WHEN s_{n} / n > 0.5 THEN 'gaz_{n}' END" for n in SHARES), "CASE WHEN bots / n > 0.5 THEN 'gaz_bot_author' END", "CASE WHEN chars < 30 THEN 'gaz_very_short' END"])
    + "], lambda x: x IS NOT NULL), list_filter(string_split(reasons, ' '), lambda x: x <> '')))) AS names FROM gz JOIN scored USING (xid))"
)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rule_names(exchange_messages(spark, sf_dir), rule_score(spark, sf_dir).select("xid", "reasons"), GAZETTEER, SHARES)


@CORE.query("rule_names", _NAMES + " SELECT xid, array_to_string(names, ' ') AS names FROM nm")
def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("xid", F.array_join("names", " ").alias("names"))


@CORE.query(
    "human_features",
    _NAMES + f", wd AS (SELECT xid, list_distinct(flatten(list({SQL_WORDS.replace('@c', 'content')}))) AS w FROM em GROUP BY xid) SELECT xid, array_to_string(list_sort(list_concat(w, list_transform(names, lambda x: '__RULE_' || x))), ' ') AS features FROM wd JOIN nm USING (xid)",
)
def human_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an exchange and the names of its rules."""
    w = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.array_distinct(F.flatten(F.collect_list(T.word_tokens(F.col("content"))))).alias("w"))
    j = w.join(_rules(spark, sf_dir), "xid")
    return j.select("xid", F.array_join(F.sort_array(F.concat("w", F.transform("names", lambda x: F.concat(F.lit("__RULE_"), x)))), " ").alias("features"))


def _space(c: str, space: str) -> str:
    return f"coalesce(list_transform(list_concat({c}.words, {c}.facts), lambda x: '{space}_' || x), [])"


@CORE.query(
    "message_features",
    f"""WITH {SQL_EM}, mm AS (SELECT *, count(*) OVER (PARTITION BY xid) AS n, {SQL_WORDS.replace('@c', 'content')} AS w, list_filter([{_FLAGS}], lambda x: x IS NOT NULL) AS sig,
  CASE WHEN author_id % 7 <> 0 THEN {{'words': list_sort({SQL_WORDS.replace('@c', 'content')})[1:30], 'facts': list_filter([{_FACTS}], lambda x: x IS NOT NULL), 'author': author_id, 'asks': regexp_matches(content, '\\?[\\s\\x0b]*$')}} END AS seen FROM em),
nb AS (SELECT mm.*, lag(seen) OVER o AS prev, lead(seen) OVER o AS nxt FROM mm WINDOW o AS (PARTITION BY xid ORDER BY position)),
cx AS (SELECT nb.id, nb.w, nb.sig, nb.channel_id, nb.content, list_filter([CASE WHEN nb.reply_to_id IS NOT NULL THEN 'CTX_is_reply' END, CASE WHEN prev.asks THEN 'CTX_prev_ends_question' END, CASE WHEN prev.author = nb.author_id THEN 'CTX_same_author_prev' END,
  CASE WHEN nb.n <= 1 OR nb.position <= 0 THEN 'POS_first' WHEN nb.position >= nb.n - 1 THEN 'POS_last' WHEN nb.position <= greatest(1, nb.n // 3) THEN 'POS_early' ELSE 'POS_middle' END,
  CASE WHEN nb.n <= 2 THEN 'EXSIZE_1-2' WHEN nb.n <= 5 THEN 'EXSIZE_3-5' WHEN nb.n <= 15 THEN 'EXSIZE_6-15' ELSE 'EXSIZE_16+' END], lambda x: x IS NOT NULL) AS flags,
  list_concat({_space('prev', 'PREV')}, {_space('nxt', 'NEXT')}, {_space('t.seen', 'REPLYTO')}) AS around FROM nb LEFT JOIN mm t ON t.id = nb.reply_to_id),
ow AS (SELECT id, list_concat(w, sig, ['CHAN_' || channel_id, CASE WHEN length(content) <= 20 THEN 'MLEN_1-20' WHEN length(content) <= 80 THEN 'MLEN_21-80' WHEN length(content) <= 300 THEN 'MLEN_81-300' ELSE 'MLEN_301+' END]) AS own, flags, around FROM cx)
SELECT id, array_to_string(list_sort(list_distinct(own)), ' ') AS plain, array_to_string(list_sort(list_distinct(list_concat(own, flags, list_filter(around, lambda x: contains(x, '_FACT_'))))), ' ') AS structural, array_to_string(list_sort(list_distinct(list_concat(own, flags, around))), ' ') AS context FROM ow""",
)
def message_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feature sets of every message; every seventh author counts as opted out."""
    em = exchange_messages(spark, sf_dir)
    c = L.context_tokens(em, em.where("author_id % 7 = 0").select("author_id"))
    f = L.message_features(em, settle(c, "context"))
    return f.select("id", *(F.array_join(s, " ").alias(s) for s in ("plain", "structural", "context")))
