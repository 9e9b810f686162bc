"""Rule scores, naive Bayes, metrics, the relevance cascade, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import classify as C
from ..operators.lexicon import load_rules
from ..operators.relational import round_robin
from ..storage import settle, table
from .base import SQL_CUR, SQL_EM, current, exchange_messages
from .registry import CORE
from .text_queries import SQL_WORDS

#: Stand-in rules for this archive's invented content (a parameter of the operators).
TERMS = r"\b(?:compiler|linker|kernel|router|firewall|capacitor|mainboard|debugger|makefile|gateway)\b"
PATTERNS = {
    "version": (r"[0-9]+\.[0-9]+\.[0-9]+", 0.2), "part_number": (r"[0-9]{3}-[0-9]{4}-[0-9]{3}", 0.3), "unix_path": (r"(^|\s)/[a-zA-Z0-9._-]+/[a-zA-Z0-9._/-]+", 0.15), "code": (r"`", 0.15),
    "archive_link": (r"https?://(wiki|archive)\.", 0.15), "pdf_attachment": (r"\.pdf\b", 0.15), "gif_links": (r"https?://\S+\.gif\b", -0.1),
}
#: Stand-in for agreeing reactions: a sign in a message that isn't an exchange's first.
AGREED = "🙂"

_ORDER = ["version", "part_number", "unix_path", "code", "archive_link", "pdf_attachment"]
_REASONS = [
    ("terms > 0", "domain_terms", "least(0.45, terms * 0.15)"), *((f"p_{n}", n, str(PATTERNS[n][1])) for n in _ORDER), ("xid IN (SELECT xid FROM ans)", "answered_question", "0.2"), ("agreed", "agreed_answer", "0.05"), ("thread", "thread", "0.05"),
    ("chars + n - 1 >= 400", "substantial", "0.1"), ("n > 1 AND tiny / n > 0.7", "mostly_tiny_messages", "-0.2"), ("p_gif_links", "gif_links", "-0.1"), ("laugh / n > 0.3", "laughter", "-0.1"),
]
_SCORE = f"""WITH {SQL_EM}, f AS (SELECT *, regexp_extract_all(lower(content), '{TERMS}') AS t FROM em),
g AS (SELECT xid, count(*) AS n, len(list_distinct(flatten(list(t)))) AS terms, sum(length(content)) AS chars, count_if(length(trim(content)) < 20) AS tiny,
  count_if(regexp_matches(lower(trim(content)), '^[^\\p{{L}}\\p{{N}}_]*(?:lol+|lmao+|rofl|ha(?:ha)+|hehe+|xd+|kek)[^\\p{{L}}\\p{{N}}_]*$')) AS laugh, bool_or(thread_id IS NOT NULL) AS thread, bool_or(position > 0 AND contains(content, '{AGREED}')) AS agreed,
  {", ".join(f"bool_or(regexp_matches(content, '{p}')) AS p_{n}" for n, (p, _) in PATTERNS.items())} FROM f GROUP BY xid),
ans AS (SELECT DISTINCT q.xid FROM em q JOIN em a ON a.xid = q.xid AND a.position > q.position AND a.author_id <> q.author_id WHERE contains(q.content, '?') AND length(trim(a.content)) >= 40),
s AS (SELECT xid, {" + ".join(f"CASE WHEN {test} THEN {w} ELSE 0 END" for test, _, w in _REASONS)} AS raw, concat_ws(' ', {", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name, _ in _REASONS)}) AS reasons FROM g),
scored AS (SELECT xid, round(greatest(0, least(1, raw)), 4)::DOUBLE AS score, reasons FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    agreed = (F.col("position") > 0) & F.col("content").contains(AGREED)
    return C.rule_score(exchange_messages(spark, sf_dir), load_rules(PATTERNS)[0], TERMS, agreed)


@CORE.query("rule_score", _SCORE + " SELECT xid, score, reasons FROM scored")
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@CORE.query("score_reasons", _SCORE + " SELECT reason, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT score, unnest(string_split(reasons, ' ')) AS reason FROM scored WHERE reasons <> '') GROUP BY reason")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _scored(spark, sf_dir).where("reasons <> ''").select("score", F.explode(F.split("reasons", " ")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@CORE.query(
    "exchange_features",
    f"WITH {SQL_EM}, t AS (SELECT xid, channel_id, content, {SQL_WORDS.replace('@c', 'content')} AS w FROM em), g AS (SELECT xid, min(channel_id) AS channel_id, count(*) AS n, list_distinct(flatten(list(w))) AS w FROM t GROUP BY xid)"
    " SELECT xid, array_to_string(list_sort(list_concat(w, ['CHAN_' || channel_id, CASE WHEN n <= 2 THEN 'LEN_1-2' WHEN n <= 5 THEN 'LEN_3-5' WHEN n <= 15 THEN 'LEN_6-15' ELSE 'LEN_16+' END])), ' ') AS features FROM g",
)
def exchange_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = exchange_messages(spark, sf_dir).select("xid", "channel_id", T.word_tokens(F.col("content")).alias("w"))
    g = m.groupBy("xid").agg(F.min("channel_id").alias("channel_id"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    size = stats.bucket(F.col("n"), [(2, "LEN_1-2"), (5, "LEN_3-5"), (15, "LEN_6-15")], "LEN_16+")
    every = F.concat("w", F.array(F.concat(F.lit("CHAN_"), F.col("channel_id").cast("string")), size))
    return g.select("xid", F.array_join(F.sort_array(every), " ").alias("features"))


@CORE.query(
    "context_features",
    f"""WITH {SQL_EM}, t AS (SELECT *, {SQL_WORDS.replace('@c', 'content')} AS w FROM em),
n AS (SELECT id, lag(w) OVER o AS pw, lead(w) OVER o AS nw, reply_to_id FROM t WINDOW o AS (PARTITION BY xid ORDER BY position))
SELECT n.id, array_to_string(list_sort(list_concat(list_transform(list_sort(coalesce(pw, []))[1:30], lambda x: 'PREV_' || x), list_transform(list_sort(coalesce(nw, []))[1:30], lambda x: 'NEXT_' || x), list_transform(list_sort(coalesce(r.w, []))[1:30], lambda x: 'REPLYTO_' || x))), ' ') AS features
FROM n LEFT JOIN t r ON r.id = n.reply_to_id""",
)
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = settle(exchange_messages(spark, sf_dir).select("xid", "position", "id", "reply_to_id", F.sort_array(T.word_tokens(F.col("content"))).alias("w")), "words")
    o = Window.partitionBy("xid").orderBy("position")
    n = t.select("id", "reply_to_id", F.lag("w").over(o).alias("pw"), F.lead("w").over(o).alias("nw"))
    j = n.join(t.select(F.col("id").alias("r_id"), F.col("w").alias("rw")), F.col("reply_to_id") == F.col("r_id"), "left")
    named = lambda c, p: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 30), lambda x: F.concat(F.lit(p), x))
    return j.select("id", F.array_join(F.sort_array(F.concat(named(F.col("pw"), "PREV_"), named(F.col("nw"), "NEXT_"), named(F.col("rw"), "REPLYTO_"))), " ").alias("features"))


# ---- naive Bayes over documents, labelled by their kind

_NB = f"""WITH ex AS (SELECT doc_id AS id, kind IN ('transcript', 'note') AS label, {SQL_WORDS.replace('@c', 'text')} AS tokens FROM documents WHERE text IS NOT NULL),
tot AS (SELECT count_if(label) AS n_pos, count_if(NOT label) AS n_neg FROM ex), x AS (SELECT id, label, unnest(tokens) AS token FROM ex),
cnt AS (SELECT token, count_if(label) AS pos, count_if(NOT label) AS neg FROM x GROUP BY token),
prob AS (SELECT token, (0.5 + (pos + neg) * ((pos / n_pos) / (pos / n_pos + neg / n_neg))) / (1 + pos + neg) AS p, pos + neg AS seen FROM cnt, tot)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return settle(d.select(F.col("doc_id").alias("id"), F.col("kind").isin("transcript", "note").alias("label"), T.word_tokens(F.col("text")).alias("tokens")), "examples")


@CORE.query("bayes_tokens", _NB + " SELECT token, pos, neg FROM cnt")
def bayes_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nb_counts(_examples(spark, sf_dir))


@CORE.query("token_probability", _NB + " SELECT token, round(p, 9) AS p, seen FROM prob")
def token_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir)
    return C.token_probability(C.nb_counts(e), C.class_totals(e)).withColumn("p", F.round("p", 9))


@CORE.query(
    "fisher_score",
    _NB
    + """, clue AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY abs(p - 0.5) DESC, token DESC) AS rn FROM x JOIN prob USING (token) WHERE abs(p - 0.5) >= 0.1 - 1e-12),
g AS (SELECT id, round(-sum(ln(1 - p)), 9) AS h, round(-sum(ln(p)), 9) AS s, count(*) AS n FROM clue WHERE rn <= 150 GROUP BY id),
i AS (SELECT id, h, s, n, unnest(range(0, n)) AS i FROM g),
sur AS (SELECT id, n, least(1, sum(exp(-h + i * ln(h) - lgamma(i + 1)))) AS qh, least(1, sum(exp(-s + i * ln(s) - lgamma(i + 1)))) AS qs FROM i GROUP BY id, n)
SELECT ex.id, round(coalesce((1 + qs - qh) / 2, 0.5), 5) AS p, coalesce(n, 0) AS n_clues FROM ex LEFT JOIN sur USING (id)""",
)
def fisher_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir)
    return C.fisher_scores(e, C.token_probability(C.nb_counts(e), C.class_totals(e))).withColumn("p", F.round("p", 5))


# ---- metrics over scored events

_SCORED = "WITH s AS (SELECT event_id AS id, round(value, 0) AS score, event_type IN ('error', 'purchase') AS label FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round("value", 0).alias("score"), F.col("event_type").isin("error", "purchase").alias("label"))


@CORE.query(
    "auc",
    _SCORED + ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s) SELECT round((sum(rk) FILTER (WHERE label) - count_if(label) * (count_if(label) + 1) / 2.0) / (count_if(label) * count_if(NOT label)), 9) AS auc, count_if(label) AS n_pos, count_if(NOT label) AS n_neg FROM r",
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.auc(_events(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@CORE.query(
    "threshold_table",
    _SCORED
    + """, t AS (SELECT unnest([1.0, 5.0, 10.0, 20.0, 40.0])::DOUBLE AS threshold), c AS (SELECT threshold, count_if(score >= threshold AND label) AS tp, count_if(score >= threshold AND NOT label) AS fp, count_if(score < threshold AND label) AS fn, count_if(score < threshold AND NOT label) AS tn FROM s, t GROUP BY threshold),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c) SELECT threshold, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m""",
)
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.threshold_table(_events(spark, sf_dir), [1.0, 5.0, 10.0, 20.0, 40.0])
    return t.select("threshold", "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_CURVE = _SCORED + ", c AS (SELECT score, count_if(label) AS pos, count_if(NOT label) AS neg FROM s GROUP BY score), a AS (SELECT score, sum(pos) OVER w AS pa, sum(neg) OVER w AS na FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@CORE.query("tuned_threshold", _CURVE + " SELECT coalesce(min(score), 1.01) AS t_high FROM a WHERE score > 0 AND pa / (pa + na) >= 0.45")
def tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tune_high(_events(spark, sf_dir), 0.45)


@CORE.query("precision_curve", _CURVE + " SELECT score, CAST(pa AS BIGINT) AS pos_above, CAST(na AS BIGINT) AS neg_above, round(pa / (pa + na), 9) AS precision FROM a")
def precision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.curve(_events(spark, sf_dir)).select("score", "pos_above", "neg_above", F.round(F.col("pos_above") / (F.col("pos_above") + F.col("neg_above")), 9).alias("precision"))


@CORE.query(
    "best_cutoff",
    "WITH r AS (SELECT length(text) // 50 AS size, kind IN ('transcript', 'note') AS label FROM documents WHERE text IS NOT NULL), c AS (SELECT size, count_if(label) AS pos, count_if(NOT label) AS neg FROM r GROUP BY size), a AS (SELECT size, sum(pos) OVER w AS p, sum(neg) OVER w AS n FROM c WINDOW w AS (ORDER BY size ROWS UNBOUNDED PRECEDING)) SELECT size + 1 AS cutoff, CAST(p + n AS BIGINT) AS n FROM a WHERE p + n >= 20 AND n / (p + n) >= 0.5 ORDER BY size DESC LIMIT 1",
)
def best_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr("length(text) div 50").alias("size"), F.col("kind").isin("transcript", "note").alias("label"))
    return C.best_cutoff(r, 0.5, 20)


@CORE.query(
    "hash_splits",
    "WITH h AS (SELECT doc_id AS id, kind AS label, ('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 2))::INTEGER AS b FROM documents) SELECT id, b % 5 = 0 AS holdout, b % 5 AS fold, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('cv:' || id)) - 1) % 5 AS INTEGER) AS strat FROM h",
)
def hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("kind").alias("label"))
    s = C.stratified_folds(d, 5, "cv").withColumnRenamed("fold", "strat")
    return s.select("id", stats.in_holdout(F.col("id")).alias("holdout"), stats.fold(F.col("id")).alias("fold"), "strat")


@CORE.query(
    "wilson_intervals",
    "WITH g AS (SELECT lower(lang) AS lang, count(*) AS n, count_if(kind = 'note') AS good FROM documents WHERE lang IS NOT NULL GROUP BY 1) SELECT lang, n, good, round((good / n + 3.8416 / (2 * n) - 1.96 * sqrt(good / n * (1 - good / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS lo, round((good / n + 3.8416 / (2 * n) + 1.96 * sqrt(good / n * (1 - good / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS hi FROM g",
)
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "note").alias("good"))
    lo, hi = stats.wilson(F.col("good"), F.col("n"))
    return g.select("lang", "n", "good", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@CORE.query("embed_head")
def embed_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic head on vectors: trained by gradient descent, tested against a plain loop."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).alias("label"), F.col("embedding").alias("v"))
    mean, scale, w, b = C.fit_head(v)
    return v.select("id", "label", F.round(C.head_score(F.col("v"), mean, scale, w, b), 6).alias("p"))


@CORE.query("out_of_fold")
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector scored by the head that was fitted without its fold: id, fold, p."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).alias("label"), F.col("embedding").alias("v"))
    f = settle(C.stratified_folds(v, 5, "cv"), "folds")
    every = None
    for k in range(5):
        mean, scale, w, b = C.fit_head(f.where(F.col("fold") != k))
        one = f.where(F.col("fold") == k).select("id", "label", "fold", F.round(C.head_score(F.col("v"), mean, scale, w, b), 6).alias("p"))
        every = one if every is None else every.unionByName(one)
    return every


# ---- the cascade

_SUBJECTS = f"""WITH {SQL_EM}, w AS (SELECT xid, content, author_id, len(regexp_extract_all(lower(content), '{TERMS}')) AS h FROM em),
sub AS (SELECT xid AS id, bool_or(author_id % 97 = 0) AS denied, CAST(sum(length(trim(content))) AS BIGINT) AS chars, CAST(sum(h) AS BIGINT) AS hits, count_if(h > 0) / count(*) AS share, (xid % 1000) / 1000.0 AS p FROM w GROUP BY xid),
cas AS (SELECT id, CASE WHEN denied THEN 'denylist' WHEN chars = 0 THEN 'no_text' WHEN hits > 0 AND share >= 0.25 THEN 'lexicon' WHEN hits = 0 AND chars < 60 THEN 'short_no_tech' WHEN p < 0.2 OR p >= 0.9 THEN 'embed' ELSE 'residue' END AS stage,
 CASE WHEN denied THEN 'irrelevant' WHEN chars = 0 THEN 'no_text' WHEN hits > 0 AND share >= 0.25 THEN 'relevant' WHEN hits = 0 AND chars < 60 THEN 'irrelevant' WHEN p < 0.2 THEN 'irrelevant' WHEN p >= 0.9 THEN 'relevant' ELSE 'undecided' END AS decision FROM sub)"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.size(F.regexp_extract_all(F.lower("content"), F.lit(TERMS), F.lit(0)))
    m = exchange_messages(spark, sf_dir).withColumn("h", h)
    return m.groupBy(F.col("xid").alias("id")).agg(
        F.max(F.col("author_id") % 97 == 0).alias("denied"), F.sum(F.length(F.trim("content"))).alias("chars"), F.sum("h").alias("hits"), (F.count_if(F.col("h") > 0) / F.count("*")).alias("share")
    ).withColumn("p", (F.col("id") % 1000) / 1000.0)


@CORE.query("cascade", _SUBJECTS + " SELECT id, stage, decision FROM cas")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cascade(_subjects(spark, sf_dir), 0.25, 60, 0.2, 0.9)


@CORE.query("stage_report", _SUBJECTS + " SELECT stage, decision, count(*) AS n, count_if(id % 2 = 0) AS labelled, count_if(id % 2 = 0 AND id % 3 = 0) AS relevant FROM cas GROUP BY ALL")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.cascade(_subjects(spark, sf_dir), 0.25, 60, 0.2, 0.9)
    even = F.col("id") % 2 == 0
    return c.groupBy("stage", "decision").agg(F.count("*").alias("n"), F.count_if(even).alias("labelled"), F.count_if(even & (F.col("id") % 3 == 0)).alias("relevant"))


@CORE.query("lexicon_share", _SUBJECTS + " SELECT id, hits, round(share, 9) AS share FROM sub WHERE hits > 0")
def lexicon_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).where("hits > 0").select("id", "hits", F.round("share", 9).alias("share"))


@CORE.query("unscored", _SUBJECTS + " SELECT id FROM sub WHERE id NOT IN (SELECT id FROM cas WHERE stage <> 'residue')")
def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settle(_subjects(spark, sf_dir), "subjects")
    scored = C.cascade(s, 0.25, 60, 0.2, 0.9).where("stage <> 'residue'").select(F.col("id").alias("s_id"))
    return s.join(scored, F.col("id") == F.col("s_id"), "left_anti").select("id")


@CORE.query(
    "gate_reduction",
    f"WITH {SQL_EM}, w AS (SELECT xid, length(content) > 0 AS ok, len(regexp_extract_all(lower(content), '{TERMS}')) AS h, len(string_split(trim(content), ' ')) AS words FROM em), s AS (SELECT xid, 100.0 * sum(h) / sum(words) AS density, count_if(words >= 5) / count(*) AS share FROM w GROUP BY xid), grid AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS d), g2 AS (SELECT unnest([0.25, 0.5])::DOUBLE AS sh)"
    " SELECT d AS density, sh AS share, count_if(s.density < d OR s.share < sh) AS removed, count(*) AS n FROM s, grid, g2 GROUP BY d, sh",
)
def gate_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exchanges a gate on term density and message length would remove, over a grid."""
    h = F.size(F.regexp_extract_all(F.lower("content"), F.lit(TERMS), F.lit(0)))
    w = F.size(F.split(F.trim("content"), " ", -1))
    s = exchange_messages(spark, sf_dir).groupBy("xid").agg((100.0 * F.sum(h) / F.sum(w)).alias("de"), (F.count_if(w >= 5) / F.count("*")).alias("sh"))
    cells = [F.struct(F.lit(d).alias("density"), F.lit(x).alias("share"), F.count_if((F.col("de") < d) | (F.col("sh") < x)).alias("removed"), F.count("*").alias("n")) for d in (0.5, 1.0, 2.0) for x in (0.25, 0.5)]
    return s.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(cells))))).alias("r")).select("r.*")


# ---- sampling


@CORE.query(
    "uncertain_sample",
    f"WITH {SQL_CUR}, p AS (SELECT id, channel_id, abs(CAST(id % 1009 AS DOUBLE) / 1009 - 0.5) AS u FROM cur WHERE deleted_at IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY u, id) AS pass FROM p) SELECT channel_id, id, pass FROM r ORDER BY pass, channel_id LIMIT 40",
)
def uncertain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = current(spark, sf_dir, "channel_id", "deleted_at").where("deleted_at IS NULL").select("id", "channel_id", F.abs((F.col("id") % 1009).cast("double") / 1009 - 0.5).alias("u"))
    return round_robin(p, "channel_id", [F.col("u"), F.col("id")], 40).select("channel_id", "id", F.col("pass").cast("long").alias("pass"))


@CORE.query(
    "eligible_pool",
    f"WITH {SQL_EM}, done AS (SELECT DISTINCT message_id FROM message_changes WHERE op = 'delete') SELECT id FROM em WHERE id NOT IN (SELECT message_id FROM done) AND author_id % 7 <> 0 AND content <> '' AND xid IN (SELECT xid FROM em GROUP BY xid HAVING count(*) >= 2)",
)
def eligible_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = settle(exchange_messages(spark, sf_dir).select("id", "xid", "author_id", "content"), "em")
    done = table(spark, sf_dir, "message_changes").where("op = 'delete'").select(F.col("message_id").alias("d_id")).distinct()
    big = em.groupBy("xid").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("xid").alias("b_xid"))
    pool = em.where("author_id % 7 <> 0 AND content <> ''").join(done, F.col("id") == F.col("d_id"), "left_anti")
    return pool.join(big, F.col("xid") == F.col("b_xid"), "left_semi").select("id")


@CORE.query(
    "frozen_slices",
    f"WITH {SQL_EM}, s AS (SELECT xid, count(*) AS n FROM em GROUP BY xid), b AS (SELECT xid, CASE WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 15 THEN '6-15' ELSE '16+' END AS bucket FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('slice:' || xid)) AS rn FROM b) SELECT xid, bucket, CASE WHEN rn <= 10 THEN 'build' WHEN rn <= 20 THEN 'holdout' ELSE 'gold' END AS slice FROM r WHERE rn <= 25",
)
def frozen_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint slices of equal size mix, by hash order."""
    s = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.count("*").alias("n"))
    b = s.withColumn("bucket", stats.bucket(F.col("n"), [(2, "1-2"), (5, "3-5"), (15, "6-15")], "16+"))
    w = Window.partitionBy("bucket").orderBy(stats.hash_order("slice", F.col("xid")))
    r = b.withColumn("rn", F.row_number().over(w)).where("rn <= 25")
    return r.select("xid", "bucket", F.when(F.col("rn") <= 10, "build").when(F.col("rn") <= 20, "holdout").otherwise("gold").alias("slice"))


@CORE.query(
    "seed_ranking",
    f"WITH {SQL_CUR}, w AS (SELECT id, len(regexp_extract_all(lower(content), '{TERMS}')) AS hits, len(regexp_extract_all(lower(content), '[a-z]+')) AS words FROM cur WHERE deleted_at IS NULL AND length(content) >= 30) SELECT id, hits, round(100.0 * hits / words, 6) AS score FROM w WHERE hits > 0 AND words >= 5 ORDER BY score DESC, hits DESC, id LIMIT 50",
)
def seed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the densest terms; the length floor goes before any tokenizing."""
    m = current(spark, sf_dir, "content", "deleted_at").where("deleted_at IS NULL AND length(content) >= 30")
    n = lambda p: F.size(F.regexp_extract_all(F.lower("content"), F.lit(p), F.lit(0))).cast("long")
    w = m.select("id", n(TERMS).alias("hits"), n("[a-z]+").alias("words")).where("hits > 0 AND words >= 5")
    w = w.withColumn("score", F.round(100.0 * F.col("hits") / F.col("words"), 6))
    return w.orderBy(F.desc("score"), F.desc("hits"), "id").limit(50).select("id", "hits", "score")
