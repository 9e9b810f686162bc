"""Tokenizers, string scalars, term statistics, full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import search as S
from ..operators.stores import refreshed_index
from ..storage import table
from .base import SQL_CUR, SQL_EM, current, exchange_messages
from .registry import CORE

_W = r"[\p{L}\p{N}_/][\p{L}\p{N}_''./+-]*"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
SQL_WORDS = rf"""list_distinct(list_filter(list_transform(regexp_extract_all(lower(@c), '{_W}'), lambda t: regexp_replace(t, '[.,!?;:)''"-]+$', '')), lambda t: t <> '' AND length(t) <= 40))"""
SQL_CLAIM = f"list_distinct(list_filter(regexp_extract_all(lower(@c), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP})))"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, "content", "reply_to_id", "channel_id", "deleted_at").where("deleted_at IS NULL AND content IS NOT NULL")


_LIVE = f"WITH {SQL_CUR}, live AS (SELECT * FROM cur WHERE deleted_at IS NULL AND content IS NOT NULL)"


@CORE.query("word_tokens", _LIVE + f" SELECT id, list_sort({SQL_WORDS.replace('@c', 'content')}) AS words FROM live")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("id", F.sort_array(T.word_tokens(F.col("content"))).alias("words"))


@CORE.query("claim_tokens", _LIVE + f" SELECT id, list_sort({SQL_CLAIM.replace('@c', 'content')}) AS words FROM live")
def claim_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("id", F.sort_array(T.claim_tokens(F.col("content"))).alias("words"))


@CORE.query("mining_words", _LIVE + " SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z][a-z0-9+#-]{2,}')) AS word FROM live) GROUP BY word")
def mining_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _live(spark, sf_dir).select(F.explode(T.mining_words(F.col("content"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


@CORE.query(
    "registrable_words",
    _LIVE
    + r""", u AS (SELECT id, unnest(regexp_extract_all(content, 'https?://[^\s<>()]+')) AS url FROM live),
h AS (SELECT id, url, string_split(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '(^|\.)www\.', '\1'), '.') AS p FROM u)
SELECT id, url, CASE WHEN len(p) >= 3 AND p[-2] IN ('co','com','org','net','ac','gov','edu') THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE p[1] END AS word FROM h""",
)
def registrable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _live(spark, sf_dir).select("id", F.explode(T.urls(F.col("content"))).alias("url"))
    return u.withColumn("word", T.registrable_word(F.col("url")))


@CORE.query(
    "stems",
    f"WITH w AS (SELECT DISTINCT unnest({SQL_CLAIM.replace('@c', 'text')}) AS word FROM documents)"
    + " SELECT word, CASE WHEN suffix(word, 'ing') AND length(word) >= 6 THEN left(word, -3) WHEN suffix(word, 'ed') AND length(word) >= 5 THEN left(word, -2) WHEN suffix(word, 'es') AND length(word) >= 5 THEN left(word, -2) WHEN suffix(word, 's') AND length(word) >= 4 THEN left(word, -1) ELSE word END AS stem FROM w",
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(T.claim_tokens(F.col("text"))).alias("word")).distinct()
    return w.withColumn("stem", T.stem(F.col("word")))


@CORE.query(
    "snippets",
    r"""SELECT doc_id, CASE WHEN length(flat) > 200 THEN left(flat, 197) || '...' ELSE flat END AS snippet, slug FROM
(SELECT doc_id, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS flat, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)""",
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.slug(F.col("source")).alias("slug"))


_FLAGS = r"""CASE WHEN regexp_matches(content, '(?i)https?://') THEN 'SIG_url' END, CASE WHEN regexp_matches(content, '\p{Nd}') THEN 'SIG_digits' END, CASE WHEN contains(content, '`') THEN 'SIG_code' END,
CASE WHEN contains(content, '?') THEN 'SIG_question' END, CASE WHEN reply_to_id IS NOT NULL THEN 'SIG_reply' END"""
_FACTS = r"""CASE WHEN regexp_matches(content, '(?i)https?://') THEN 'FACT_url' END, CASE WHEN regexp_matches(content, '(^|[^0-9.])\d+(\.\d+)+') THEN 'FACT_version' END, CASE WHEN regexp_matches(content, '(^|[^0-9])\d{3}-\d{4}-\d{3}') THEN 'FACT_partnumber' END,
CASE WHEN regexp_matches(content, '(^|\s)/[a-zA-Z0-9._-]+/[a-zA-Z0-9._/-]+') THEN 'FACT_path' END, CASE WHEN contains(content, '`') THEN 'FACT_code' END"""


@CORE.query(
    "message_signals",
    _LIVE + f" SELECT id, array_to_string(list_filter([{_FLAGS}], lambda x: x IS NOT NULL), ' ') AS signals, array_to_string(list_filter([{_FACTS}], lambda x: x IS NOT NULL), ' ') AS facts FROM live",
)
def message_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return _live(spark, sf_dir).select("id", F.array_join(T.signals(c, F.col("reply_to_id")), " ").alias("signals"), F.array_join(T.fact_shapes(c), " ").alias("facts"))


@CORE.query(
    "scrub_scan",
    r"""SELECT id, regexp_replace(content, '(?i)https?://(?:[a-z0-9-]+\.)*(?:wiki\.[a-z0-9-]+\.example)/\S*', '[link removed]', 'g') AS scrubbed, len(regexp_extract_all(content, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+')) AS n_emails
FROM source_messages WHERE content IS NOT NULL""",
)
def scrub_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    mails = T.all_matches(c, r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+")
    return table(spark, sf_dir, "source_messages").where("content IS NOT NULL").select("id", T.scrubbed(c, r"wiki\.[a-z0-9-]+\.example").alias("scrubbed"), F.size(mails).cast("long").alias("n_emails"))


@CORE.query(
    "scan_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
SELECT doc_id, no AS line_no, count(*) AS n_numbers FROM (SELECT doc_id, no, unnest(regexp_extract_all(line, '\d+')) AS x FROM l) GROUP BY doc_id, no""",
)
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    hits = l.select("doc_id", (F.col("no") + 1).cast("long").alias("line_no"), F.explode(T.all_matches(F.col("line"), r"\d+")).alias("x"))
    return hits.groupBy("doc_id", "line_no").agg(F.count("*").alias("n_numbers"))


@CORE.query("permalinks", f"WITH {SQL_CUR} SELECT id, concat_ws('/', 'https://chat.example/channels', guild_id, channel_id, id) AS link FROM cur")
def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, "channel_id", "guild_id").select("id", T.permalink(F.col("guild_id"), F.col("channel_id"), F.col("id")).alias("link"))


_NEAR = " OR ".join(f"regexp_matches(lower(content), '(?s)(?:{'|'.join(T.PERSONS)}).{{0,{40 - n}}}(?:{'|'.join(v for v in T.SPEECH if len(v) == n)})')" for n in sorted({len(v) for v in T.SPEECH}))


@CORE.query(
    "claim_shapes",
    _LIVE
    + rf""" SELECT channel_id, count(*) AS total, count_if(regexp_matches(content, '(?i)^\s*(?:a|an|the|one|another)?\s*(?:{'|'.join(T.NOUNS)})\b')) AS person_subject,
  count_if(regexp_matches(lower(content), '\baccording to\b') OR {_NEAR}) AS attributed FROM live GROUP BY channel_id""",
)
def claim_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return _live(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("total"), F.count_if(T.person_subject(c)).alias("person_subject"), F.count_if(T.attributed(c)).alias("attributed"))


@CORE.query(
    "pseudonyms",
    f"WITH {SQL_EM}, f AS (SELECT xid, author_id, min(position) AS first FROM em GROUP BY xid, author_id), r AS (SELECT *, row_number() OVER (PARTITION BY xid ORDER BY first) - 1 AS no FROM f)"
    + " SELECT xid, author_id, 'user-' || left(sha256('salt:' || author_id), 4) AS pseudonym, CASE WHEN no < 26 THEN chr(CAST(65 + no AS INTEGER)) ELSE chr(CAST(64 + no // 26 AS INTEGER)) || chr(CAST(65 + no % 26 AS INTEGER)) END AS member FROM r",
)
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.members(exchange_messages(spark, sf_dir), "salt").select("xid", "author_id", "pseudonym", "member")


@CORE.query(
    "unique_pseudonyms",
    f"WITH {SQL_CUR}, a AS (SELECT DISTINCT author_id, sha256('salt:' || author_id) AS h FROM cur), p AS (SELECT *, row_number() OVER (PARTITION BY left(h, 4) ORDER BY author_id) AS rn FROM a) SELECT author_id, 'user-' || left(h, CASE WHEN rn = 1 THEN 4 ELSE 12 END) AS pseudonym FROM p",
)
def unique_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_pseudonyms(current(spark, sf_dir, "author_id").select("author_id").distinct(), "salt")


@CORE.query(
    "document_frequency",
    f"WITH t AS (SELECT lang, unnest({SQL_WORDS.replace('@c', 'text')}) AS term FROM documents WHERE lang IS NOT NULL) SELECT lower(lang) AS lang, term, count(*) AS n_docs FROM t GROUP BY lower(lang), term",
)
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return S.document_frequency(d.select(F.lower("lang").alias("lang"), "text"), "lang", "text")


_TECH = "lower(name) LIKE '%a%'"
_MINED = r"""WITH t AS (SELECT lower(trim(term)) AS term, sum(coalesce(tech, 0)) AS tech, sum(coalesce("off", 0)) AS off_ FROM mined_terms WHERE trim(term) <> '' GROUP BY 1),
n AS (SELECT sum(tech) AS tech_all, sum(off_) AS off_all FROM t)"""


@CORE.query(
    "mine_terms",
    _MINED
    + " SELECT term, CAST(tech AS BIGINT) AS tech, CAST(off_ AS BIGINT) AS \"off\", round(ln((tech + 0.5) / (tech_all + 1)) - ln((off_ + 0.5) / (off_all + 1)), 6) AS log_odds FROM t, n WHERE tech >= 30 AND ln((tech + 0.5) / (tech_all + 1)) > ln((off_ + 0.5) / (off_all + 1)) ORDER BY log_odds DESC, term LIMIT 400",
)
def mine_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mine_terms(table(spark, sf_dir, "mined_terms"))


@CORE.query(
    "term_collisions",
    _MINED + " SELECT term, CAST(tech AS BIGINT) AS tech, CAST(off_ AS BIGINT) AS \"off\" FROM t, n WHERE off_ >= 10 AND tech > 0 AND (tech / tech_all) / (off_ / off_all) < 10",
)
def term_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collisions(table(spark, sf_dir, "mined_terms"))


_QUERY = "works better once"
_TF = f"""tf AS (SELECT id, xid, term, count(*) AS tf FROM (SELECT id, xid, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_./-]*[\\p{{L}}\\p{{N}}]')) AS term FROM em) GROUP BY ALL),
len AS (SELECT id, sum(tf) AS n FROM tf GROUP BY id), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('works', 'better', 'once') GROUP BY term),
s AS (SELECT tf.id, tf.xid, count(*) AS terms, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df USING (term) JOIN len USING (id), st GROUP BY tf.id, tf.xid)"""


@CORE.query("search_messages", f"WITH {SQL_EM}, {_TF} SELECT id, round(score, 6) AS score FROM s WHERE terms = 3 ORDER BY score DESC, id LIMIT 50")
def search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(exchange_messages(spark, sf_dir), _QUERY, limit=50)


@CORE.query(
    "search_exchanges",
    f"WITH {SQL_EM}, {_TF} SELECT xid, round(sum(score), 6) AS score, count(*) AS n_hits, max(id) AS latest FROM s WHERE terms = 3 GROUP BY xid ORDER BY score DESC, latest DESC LIMIT 20",
)
def search_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_groups(exchange_messages(spark, sf_dir), _QUERY, limit=20)


@CORE.query("inverted_index", f"WITH {SQL_EM}, {_TF} SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an index in which the messages of a tenth of the ids were rebuilt."""
    em = exchange_messages(spark, sf_dir)
    index = S.inverted_index(em)
    changed = em.where("id % 10 = 0").select("id")
    index = refreshed_index(index, changed, S.inverted_index(em.where("id % 10 = 0")))
    return index.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@CORE.query(
    "exchange_hits",
    f"""WITH {SQL_EM}, {_TF}, hx AS (SELECT xid, round(sum(score), 6) AS score, count(*) AS n_hits, max(id) AS latest FROM s WHERE terms = 3 GROUP BY xid ORDER BY score DESC, latest DESC LIMIT 20),
sn AS (SELECT s.xid, s.id, row_number() OVER (PARTITION BY s.xid ORDER BY round(s.score, 6) DESC, s.id) AS rn FROM s JOIN hx USING (xid) WHERE s.terms = 3),
tx AS (SELECT sn.xid, string_agg(CASE WHEN length(f) > 200 THEN left(f, 197) || '...' ELSE f END, ' | ' ORDER BY rn) AS snippets FROM (SELECT sn.*, trim(regexp_replace(em.content, '[\\s\\x0b]+', ' ', 'g')) AS f FROM sn JOIN em USING (id)) sn WHERE rn <= 2 GROUP BY sn.xid)
SELECT hx.xid, score, n_hits, (SELECT count(DISTINCT author_id) FROM em WHERE em.xid = hx.xid AND author_id % 7 <> 0) AS participants, snippets FROM hx JOIN tx USING (xid)""",
)
def exchange_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best exchanges with two snippets and the number of their participants that didn't opt out."""
    em = exchange_messages(spark, sf_dir)
    return S.group_hits(em, _QUERY, 20, em.where("author_id % 7 = 0").select("author_id"))


@CORE.query("top_tokens", f"WITH {SQL_EM}, x AS (SELECT id, contains(content, '?') AS label, unnest({SQL_WORDS.replace('@c', 'content')}) AS token FROM em), tot AS (SELECT count_if(contains(content, '?')) AS n_pos, count_if(NOT contains(content, '?')) AS n_neg FROM em), cnt AS (SELECT token, count_if(label) AS pos, count_if(NOT label) AS neg FROM x GROUP BY token), pr AS (SELECT token, (0.5 + (pos + neg) * ((pos / n_pos) / (pos / n_pos + neg / n_neg))) / (1 + pos + neg) AS p FROM cnt, tot) SELECT token, round(p, 9) AS p FROM pr ORDER BY round(abs(pr.p - 0.5), 9) DESC, token LIMIT 40")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that tell questions from the rest best (a top list)."""
    e = exchange_messages(spark, sf_dir).select("id", F.col("content").contains("?").alias("label"), T.word_tokens(F.col("content")).alias("tokens"))
    return C.top_tokens(C.token_probability(C.nb_counts(e), C.class_totals(e)), 40).withColumn("p", F.round("p", 9))


@CORE.query(
    "related_any",
    f"WITH {SQL_EM}, {_TF} SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 30",
)
def related_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(exchange_messages(spark, sf_dir), _QUERY, limit=30, every=False)


@CORE.query(
    "context_window",
    f"""WITH {SQL_EM}, r AS (SELECT channel_id, id, content, row_number() OVER (PARTITION BY channel_id ORDER BY id) AS rn FROM em),
hits AS (SELECT * FROM r WHERE contains(content, 'overdue?'))
SELECT h.id AS hit_id, r.id, r.rn - h.rn AS distance FROM hits h JOIN r ON r.channel_id = h.channel_id AND r.rn BETWEEN h.rn - 2 AND h.rn + 2""",
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.channel_context(exchange_messages(spark, sf_dir), F.col("content").contains("overdue?"), 2)


@CORE.query(
    "embedding_windows",
    f"""WITH {SQL_EM}, pc AS (SELECT xid, position, i, least(512, length(content) - 512 * i) AS chars FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(content) / 512.0) AS BIGINT)))) AS i FROM em)),
sq AS (SELECT xid, CAST(ceil(chars / 4.0) AS BIGINT) AS t, row_number() OVER (PARTITION BY xid ORDER BY position, i) AS seq FROM pc),
ww AS (WITH RECURSIVE w AS (SELECT xid, seq, t, CAST(0 AS BIGINT) AS window_no, t AS used FROM sq WHERE seq = 1
  UNION ALL SELECT s.xid, s.seq, s.t, CASE WHEN used + s.t > 128 THEN window_no + 1 ELSE window_no END, CASE WHEN used + s.t > 128 THEN 0 ELSE used END + s.t FROM w JOIN sq s ON s.xid = w.xid AND s.seq = w.seq + 1) SELECT * FROM w)
SELECT xid, window_no, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM ww GROUP BY xid, window_no""",
)
def embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_windows(exchange_messages(spark, sf_dir), 128)
