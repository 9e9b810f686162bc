"""Validation and publication of statements, judging queues, metrics of decisions.

Replies stand in for extracted statements: a reply states something of its
exchange, cites what it replies to, and is reviewed by the hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import classify as C
from ..operators import publish as P
from ..operators.classify import cascade
from ..operators.grouping import recipe_versions
from ..operators.vectors import best_match
from ..storage import settle, spread, table
from .base import SQL_CUR, SQL_EM, exchange_messages
from .classify_queries import _SCORE, _SCORED, _SUBJECTS, _events, _subjects, rule_score
from .registry import CORE

_REVIEW = "CASE WHEN {0} % 11 = 0 THEN 'wrong' WHEN {0} % 11 = 1 THEN 'made_up' WHEN {0} % 11 IN (2, 3, 4) THEN 'good' END"
_VERDICT = "CASE WHEN {0} % 5 = 0 THEN 'unsupported_fact' WHEN {0} % 5 = 1 THEN 'low_overlap' WHEN {0} % 5 = 2 THEN 'uncheckable' WHEN {0} % 5 = 3 THEN 'supported' END"
_CLAIMS = f"""WITH {SQL_EM}, cl AS (SELECT id AS claim, xid, author_id AS speaker, content AS statement, CASE WHEN reply_to_id IS NULL THEN [] ELSE [reply_to_id] END AS refs, {_REVIEW.format('id')} AS review, {_VERDICT.format('(id // 7)')} AS verdict,
  contains(content, '`') OR regexp_matches(content, '[0-9]') AS tech FROM em)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir)
    refs = F.when(F.col("reply_to_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("reply_to_id"))
    tech = F.col("content").contains("`") | F.col("content").rlike("[0-9]")
    return em.select(F.col("id").alias("claim"), "xid", F.col("author_id").alias("speaker"), F.col("content").alias("statement"), refs.alias("refs"), F.expr(_REVIEW.format("id")).alias("review"), F.expr(_VERDICT.format("(id div 7)")).alias("verdict"), tech.alias("tech"))


@CORE.query(
    "claim_validation",
    _CLAIMS
    + r""", nm AS (SELECT DISTINCT xid, lower(name) AS name FROM em WHERE name IS NOT NULL),
lk AS (SELECT DISTINCT claim FROM cl JOIN nm USING (xid) WHERE regexp_matches(' ' || lower(statement) || ' ', '[^\p{L}\p{N}_]' || regexp_replace(nm.name, '([^\p{L}\p{N}_ ])', '\\\1', 'g') || '[^\p{L}\p{N}_]')),
pr AS (SELECT claim, CASE WHEN trim(statement, E' \t\n\r') = '' THEN 'empty statement' WHEN len(refs) = 0 THEN 'no refs' WHEN refs[1] NOT IN (SELECT id FROM em e WHERE e.xid = cl.xid) THEN 'unknown ref' WHEN claim IN (SELECT claim FROM lk) THEN 'name leak' ELSE 'accepted' END AS problem FROM cl)
SELECT problem, count(*) AS n, min(claim) AS first FROM pr GROUP BY problem""",
)
def claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir)
    v = P.validate(claims(spark, sf_dir), em.select("xid", "id", "author_id"), em.select("xid", "name").distinct())
    return v.groupBy(F.coalesce("problem", F.lit("accepted")).alias("problem")).agg(F.count("*").alias("n"), F.min("claim").alias("first"))


_FIXES = "fx AS (SELECT xid, statement, CASE WHEN max(claim) % 2 = 0 THEN 'corrected' END AS fix FROM cl WHERE claim % 13 = 0 GROUP BY xid, statement UNION ALL SELECT -1, 'nobody said this', NULL)"
_PUB = _CLAIMS + f""", {_FIXES}, fj AS (SELECT cl.*, coalesce(fx.fix, cl.statement) AS text, fx.xid IS NOT NULL AND fx.fix IS NULL AS dropped FROM cl LEFT JOIN fx ON fx.xid = cl.xid AND fx.statement = cl.statement),
ex AS (SELECT *, CASE WHEN speaker % 17 = 0 THEN 'speaker' WHEN review IN ('wrong', 'made_up', 'not_useful') THEN 'review' WHEN NOT (coalesce(review = 'good', false) OR coalesce(verdict, 'unchecked') IN ('supported', 'uncheckable')) THEN 'check:' || coalesce(verdict, 'unchecked')
  WHEN dropped THEN 'corrected' WHEN NOT tech THEN 'no_tech' END AS reason FROM fj)"""


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = settle(claims(spark, sf_dir), "claims")
    fixes = c.where("claim % 13 = 0").groupBy("xid", "statement").agg(F.max("claim").alias("m")).select("xid", "statement", F.when(F.col("m") % 2 == 0, "corrected").alias("replace"))
    fixes = fixes.unionByName(spark.createDataFrame([(-1, "nobody said this", None)], "xid long, statement string, replace string"))
    out, unmatched = P.corrected(c, fixes)
    reason = P.exclusion(F.col("speaker") % 17 == 0, F.col("review"), F.col("verdict"), F.col("dropped"), P.has_tech(F.when(F.col("tech"), F.array(F.lit(1))), F.array()), ("supported", "uncheckable"))
    return out.withColumn("reason", reason), unmatched


@CORE.query("exclusion_reasons", _PUB + " SELECT coalesce(reason, 'published') AS reason, count(*) AS n, count(DISTINCT text) AS texts FROM ex GROUP BY 1")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _published(spark, sf_dir)
    return p.groupBy(F.coalesce("reason", F.lit("published")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("statement").alias("texts"))


@CORE.query("unmatched_corrections", _PUB + " SELECT xid, statement FROM fx WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.xid = fx.xid AND cl.statement = fx.statement)")
def unmatched_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir)[1]


@CORE.query("published_claims", _PUB + " SELECT xid, speaker, text AS statement, min(claim) AS claim FROM ex WHERE reason IS NULL GROUP BY xid, speaker, text")
def published_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left, once per exchange, speaker and statement."""
    p, _ = _published(spark, sf_dir)
    return P.first_of_each(p.where("reason IS NULL").select("xid", "speaker", "statement", "claim"), ["xid", "speaker", "statement"], "claim")


_LORE = f"""WITH {SQL_CUR}, st AS (SELECT id AS claim, CASE WHEN id % 10 = 0 THEN 'trial' ELSE 'live' END AS mode, deleted_at AS retracted_at, CASE WHEN id % 3 = 0 THEN 'known' ELSE 'unknown' END AS novelty, reply_to_id AS supersedes FROM cur)
SELECT claim FROM st WHERE mode = 'live' AND retracted_at IS NULL AND novelty <> 'known' AND NOT EXISTS (SELECT 1 FROM st n WHERE n.supersedes = st.claim AND n.retracted_at IS NULL AND n.mode = 'live')"""


@CORE.query("live_claims", _LORE)
def live_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import current

    c = current(spark, sf_dir, "deleted_at", "reply_to_id")
    c = c.select(F.col("id").alias("claim"), F.when(F.col("id") % 10 == 0, "trial").otherwise("live").alias("mode"), F.col("deleted_at").alias("retracted_at"), F.when(F.col("id") % 3 == 0, "known").otherwise("unknown").alias("novelty"), F.col("reply_to_id").alias("supersedes"))
    return P.live(c).select("claim")


_MEMBERS = "mb AS (SELECT DISTINCT xid, author_id, 'user-' || left(sha256('salt:' || author_id), 4) AS pseudonym FROM em)"


@CORE.query(
    "claim_speakers",
    _CLAIMS + f", {_MEMBERS}, sp AS (SELECT claim, xid, 'user-' || left(sha256('salt:' || speaker), 4) AS speaker FROM cl WHERE claim % 5 <> 0 UNION ALL SELECT claim, xid, 'user-nobody' FROM cl WHERE claim % 5 = 0), un AS (SELECT xid, pseudonym, min(author_id) AS author_id FROM mb GROUP BY xid, pseudonym)"
    " SELECT sp.claim, un.author_id, coalesce(un.author_id % 17 = 0, false) AS is_dropped FROM sp LEFT JOIN un ON un.xid = sp.xid AND un.pseudonym = sp.speaker",
)
def claim_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers found again by their pseudonyms in the exchange."""
    from ..functions.text import pseudonym

    c = claims(spark, sf_dir).select("claim", "xid", F.when(F.col("claim") % 5 == 0, "user-nobody").otherwise(pseudonym(F.col("speaker"), "salt")).alias("speaker"))
    m = exchange_messages(spark, sf_dir).select("xid", "author_id", pseudonym(F.col("author_id"), "salt").alias("pseudonym")).groupBy("xid", "pseudonym").agg(F.min("author_id").alias("author_id"))
    return P.speakers(c, m, m.where("author_id % 17 = 0").select("author_id"))[0]


@CORE.query("kept_exchanges", f"WITH {SQL_EM} SELECT DISTINCT xid FROM em WHERE author_id % 17 <> 0")
def kept_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir).select("xid", "author_id", F.col("author_id").cast("string").alias("pseudonym")).distinct()
    c = em.select(F.lit(0).alias("claim"), "xid", F.lit("x").alias("speaker"))
    return P.speakers(c, em, em.where("author_id % 17 = 0").select("author_id"))[1]


@CORE.query(
    "redacted_names",
    f"""WITH {SQL_EM}, us AS (SELECT xid, author_id, min(name) AS name FROM em GROUP BY xid, author_id),
pt AS (SELECT xid, author_id, unnest(list_distinct([lower(trim(name))] || string_split_regex(lower(trim(name)), '\\s+'))) AS p FROM us WHERE name IS NOT NULL),
hit AS (SELECT em.id, count(DISTINCT p) AS k FROM em JOIN pt USING (xid) WHERE length(p) >= 3 AND regexp_matches(' ' || lower(content) || ' ', '[^\\p{{L}}\\p{{N}}_]' || regexp_replace(p, '([^\\p{{L}}\\p{{N}}_ ])', '\\\\\\1', 'g') || '[^\\p{{L}}\\p{{N}}_]') GROUP BY em.id)
SELECT em.id, hit.id IS NOT NULL AS has_names FROM em LEFT JOIN hit USING (id)""",
)
def redacted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages name somebody of their exchange (the texts themselves are tested against a plain version)."""
    from ..functions.text import pseudonym

    em = exchange_messages(spark, sf_dir)
    m = em.groupBy("xid", "author_id").agg(F.min("name").alias("name")).withColumn("pseudonym", pseudonym(F.col("author_id"), "salt", 8))
    return P.redact_names(em.select("xid", "id", "content"), m).select("id", (F.col("n_names") > 0).alias("has_names"))


@CORE.query(
    "corroboration",
    _CLAIMS + ", gp AS (SELECT xid AS topic, statement AS lead, count(*) AS n, count(DISTINCT speaker) AS s FROM cl GROUP BY 1, 2) SELECT CASE WHEN s >= 3 THEN '3+' ELSE CAST(s AS VARCHAR) END AS speakers, count(*) AS groups, CAST(sum(n) AS BIGINT) AS claims FROM gp GROUP BY 1",
)
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.corroboration(claims(spark, sf_dir).select(F.col("xid").alias("topic"), F.col("statement").alias("lead"), "claim", "speaker"))


_ANN = _SUBJECTS + """, an AS (SELECT id AS xid, stage, CASE WHEN decision <> 'undecided' THEN decision WHEN stage = 'residue' THEN 'residue' END AS label, 2 AS run_at FROM cas UNION ALL SELECT id, 'lexicon', 'relevant', 1 FROM cas UNION ALL SELECT id, 'lexicon', CASE WHEN hits > 0 THEN 'relevant' END, 2 FROM sub)"""


@CORE.query(
    "cascade_origins",
    _ANN + ", ls AS (SELECT an.* FROM an JOIN (SELECT xid, max(run_at) AS run_at FROM an GROUP BY xid) USING (xid, run_at) WHERE label IS NOT NULL) SELECT xid, CASE WHEN s = 'residue' THEN 'undecided' ELSE s END AS origin FROM (SELECT xid, arg_max(stage, list_position(['denylist', 'no_text', 'lexicon', 'short_no_tech', 'embed', 'residue'], stage)) AS s FROM ls GROUP BY xid)",
)
def cascade_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settle(_subjects(spark, sf_dir), "subjects")
    c = settle(cascade(s, 0.25, 60, 0.2, 0.9), "cascade")
    label = F.when(F.col("decision") != "undecided", F.col("decision")).when(F.col("stage") == "residue", "residue")
    a = c.select(F.col("id").alias("xid"), "stage", label.alias("label"), F.lit(2).alias("run_at"))
    a = a.unionByName(c.select(F.col("id").alias("xid"), F.lit("lexicon").alias("stage"), F.lit("relevant").alias("label"), F.lit(1).alias("run_at")))
    a = a.unionByName(s.select(F.col("id").alias("xid"), F.lit("lexicon").alias("stage"), F.when(F.col("hits") > 0, "relevant").alias("label"), F.lit(2).alias("run_at")))
    return P.origins(a, ("denylist", "no_text", "lexicon", "short_no_tech", "embed", "residue"))


@CORE.query(
    "cascade_outcomes",
    _SUBJECTS + """, oc AS (SELECT id AS xid, 'lexicon' AS scorer, CASE WHEN stage = 'lexicon' THEN decision END AS label FROM cas WHERE stage IN ('lexicon', 'short_no_tech', 'embed', 'residue') UNION ALL SELECT id, stage, CASE WHEN decision <> 'undecided' THEN decision END FROM cas WHERE stage <> 'lexicon')
SELECT xid, scorer, coalesce(label, '') AS label, CAST(4 AS BIGINT) AS version FROM oc""",
)
def cascade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outcomes(cascade(_subjects(spark, sf_dir), 0.25, 60, 0.2, 0.9), 4).withColumn("label", F.coalesce("label", F.lit("")))


@CORE.query("residue_channels", _SUBJECTS + ", ch AS (SELECT xid, min(channel_id) AS channel_id FROM em GROUP BY xid) SELECT channel_id, count(*) AS n FROM cas JOIN ch ON ch.xid = cas.id WHERE stage = 'residue' GROUP BY channel_id ORDER BY n DESC, channel_id LIMIT 20")
def residue_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels with most undecided exchanges (a top list)."""
    c = cascade(_subjects(spark, sf_dir), 0.25, 60, 0.2, 0.9).where("stage = 'residue'").select(F.col("id").alias("xid"))
    ch = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.min("channel_id").alias("channel_id"))
    return c.join(ch, "xid").groupBy("channel_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel_id").limit(20)


@CORE.query(
    "claim_cases",
    _CLAIMS + " SELECT xid, speaker, statement, max(claim) AS claim, arg_max(review, claim) AS review FROM cl WHERE review IS NOT NULL GROUP BY xid, speaker, statement",
)
def claim_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed statements as cases, once per exchange, speaker and statement: the latest review counts."""
    from ..operators.current import latest_by

    c = claims(spark, sf_dir).where("review IS NOT NULL").select("xid", "speaker", "statement", "claim", "review")
    return latest_by(c.withColumn("no", F.col("claim")), ["xid", "speaker", "statement"], ["no"], ["claim", "review"])


@CORE.query(
    "run_report",
    _CLAIMS + ", x AS (SELECT xid, xid % 4 AS run, count(*) FILTER (WHERE len(refs) > 0) AS n, count_if(review IN ('wrong', 'made_up')) AS rejected, count_if(verdict = 'supported') AS supported, count_if(verdict IS NULL) AS unchecked FROM cl GROUP BY xid) SELECT run, count_if(xid % 19 <> 0) AS ok, count_if(xid % 19 = 0) AS failed, count_if(n = 0) AS without_claims, CAST(sum(n) AS BIGINT) AS claims, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(supported) AS BIGINT) AS supported, CAST(sum(unchecked) AS BIGINT) AS unchecked FROM x GROUP BY run",
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each extraction run brought; an exchange belongs to the run of its number's rest by four."""
    x = claims(spark, sf_dir).groupBy("xid").agg(
        F.count_if(F.size("refs") > 0).alias("n"), F.count_if(F.col("review").isin("wrong", "made_up")).alias("rejected"), F.count_if(F.col("verdict") == "supported").alias("supported"), F.count_if(F.col("verdict").isNull()).alias("unchecked")
    )
    bad = F.col("xid") % 19 == 0
    return x.groupBy((F.col("xid") % 4).alias("run")).agg(
        F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.count_if(F.col("n") == 0).alias("without_claims"), F.sum("n").alias("claims"), F.sum("rejected").alias("rejected"), F.sum("supported").alias("supported"), F.sum("unchecked").alias("unchecked")
    )


# ---- queues

@CORE.query("likely_irrelevant", _SCORE + ", pl AS (SELECT xid, score FROM scored WHERE xid % 3 <> 0 ORDER BY score, xid LIMIT 2000), sh AS (SELECT xid, count_if(contains(content, '`')) / count(*) AS share FROM em GROUP BY xid) SELECT pl.xid, score, round(share, 9) AS share FROM pl JOIN sh USING (xid) ORDER BY share, score, xid LIMIT 100")
def likely_irrelevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unjudged exchanges: of the 2,000 lowest scores those with the least share of code (a queue of stated size)."""
    share = exchange_messages(spark, sf_dir).groupBy("xid").agg((F.count_if(F.col("content").contains("`")) / F.count("*")).alias("share"))
    rows = rule_score(spark, sf_dir).where("xid % 3 <> 0").join(share, "xid").select("xid", "score", F.round("share", 9).alias("share"))
    return P.pooled_rerank(rows, [F.col("score"), F.col("xid")], 2000, [F.col("share"), F.col("score"), F.col("xid")], 100)


_BUCKET = "CASE WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 15 THEN '6-15' ELSE '16+' END"


@CORE.query(
    "trial_sample",
    f"WITH {SQL_EM}, s AS (SELECT xid, min(channel_id) AS channel_id, count(*) AS n FROM em GROUP BY xid), b AS (SELECT xid, lpad(CAST(channel_id AS VARCHAR), 20, '0') || ':' || {_BUCKET} AS stratum FROM s), r AS (SELECT xid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('trial:' || xid)) AS pass FROM b) SELECT xid, stratum FROM r ORDER BY pass, stratum LIMIT 80",
)
def trial_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 exchanges dealt round-robin over channels and sizes."""
    from ..operators.relational import round_robin

    s = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.min("channel_id").alias("channel_id"), F.count("*").alias("n"))
    stratum = F.concat(F.lpad(F.col("channel_id").cast("string"), 20, "0"), F.lit(":"), stats.bucket(F.col("n"), [(2, "1-2"), (5, "3-5"), (15, "6-15")], "16+"))
    return round_robin(s.select("xid", stratum.alias("stratum")), "stratum", [stats.hash_order("trial", F.col("xid"))], 80).select("xid", "stratum")


@CORE.query("size_matched_sample")
def size_matched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 judged exchanges in the size mix of all others (tested against a plain version)."""
    s = exchange_messages(spark, sf_dir).groupBy("xid").agg(F.count("*").alias("n")).withColumn("bucket", stats.bucket(F.col("n"), [(2, "1-2"), (5, "3-5"), (15, "6-15")], "16+"))
    return P.size_matched(s.where("xid % 3 = 0"), s.where("xid % 3 <> 0"), "bucket", [stats.hash_order("match", F.col("xid"))], 60).select("xid", "bucket")


@CORE.query("undecided_queue", _SUBJECTS + " SELECT id FROM cas WHERE stage = 'residue' ORDER BY sha256('undecided:' || id) LIMIT 50")
def undecided_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cascade(_subjects(spark, sf_dir), 0.25, 60, 0.2, 0.9).where("stage = 'residue'")
    return c.orderBy(stats.hash_order("undecided", F.col("id"))).limit(50).select("id")


# ---- metrics

@CORE.query(
    "score_summary",
    _SCORED + """, c AS (SELECT score, count_if(label) AS pos, count_if(NOT label) AS neg FROM s GROUP BY score), a AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM c WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT *, round(2 * tp / (tp + fp + p), 12) AS f1, tp / p AS recall FROM a)
SELECT CAST(max(p) AS BIGINT) AS n_pos, CAST(max(q) AS BIGINT) AS n_neg, arg_max(score, (f1, -score)) AS best_threshold, round(max(f1), 9) AS f1, arg_max(score, score) FILTER (WHERE recall >= 0.95) AS floor_threshold, round(arg_max(1 - fp / q, score) FILTER (WHERE recall >= 0.95), 9) AS negative_recall FROM f""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summarize(_events(spark, sf_dir)).withColumn("f1", F.round("f1", 9)).withColumn("negative_recall", F.round("negative_recall", 9))


@CORE.query(
    "irrelevant_threshold",
    _SCORED + ", p AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM s WHERE label) SELECT max(score) AS threshold FROM p WHERE i = CAST(floor(0.05 * n + 1e-9) AS BIGINT)",
)
def irrelevant_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.irrelevant_threshold(_events(spark, sf_dir), 0.95)


@CORE.query(
    "side_stats",
    _SCORED + ", t AS (SELECT count_if(label) AS p, count_if(NOT label) AS q, count_if(score < 5) AS ln, count_if(score < 5 AND NOT label) AS lh, count_if(score >= 20) AS hn, count_if(score >= 20 AND label) AS hh FROM s) SELECT 'irrelevant' AS side, ln AS n, round(lh / ln, 9) AS precision, round(lh / q, 9) AS recall FROM t UNION ALL SELECT 'relevant', hn, round(hh / hn, 9), round(hh / p, 9) FROM t",
)
def side_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.side_stats(_events(spark, sf_dir), 5, 20).select("side", "n", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@CORE.query(
    "discard_pile",
    _SCORED + ", t AS (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS threshold) SELECT threshold, round(count_if(score >= threshold AND label) / count_if(label), 9) AS keep_lost, round(count_if(score >= threshold AND NOT label) / count_if(NOT label), 9) AS trash_caught FROM s, t GROUP BY threshold",
)
def discard_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.discard_pile(_events(spark, sf_dir), (5.0, 10.0, 20.0))
    return d.select("threshold", F.round("keep_lost", 9).alias("keep_lost"), F.round("trash_caught", 9).alias("trash_caught"))


_GRID = [round(i * 0.05, 2) for i in range(21)]


@CORE.query(
    "check_tuning",
    f"WITH it AS (SELECT (event_id % 101) / 100.0 AS overlap, event_id % 9 = 0 AS miss, event_type IN ('error', 'purchase') AS bad FROM events), g AS (SELECT unnest({_GRID})::DOUBLE AS threshold), r AS (SELECT threshold, count_if((miss OR overlap < threshold) AND bad) AS caught, count_if(bad) AS positives, count_if((miss OR overlap < threshold) AND NOT bad) AS false_alarms, count_if(NOT bad) AS negatives FROM it, g GROUP BY threshold),"
    " f AS (SELECT *, CASE WHEN caught > 0 THEN 2 * caught / (caught + false_alarms + positives) ELSE 0 END AS f1 FROM r) SELECT threshold, caught, positives, false_alarms, negatives, round(f1, 9) AS f1 FROM f ORDER BY round(f.f1, 12) DESC, threshold LIMIT 1",
)
def check_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(((F.col("event_id") % 101) / 100.0).alias("overlap"), (F.col("event_id") % 9 == 0).alias("has_missing"), F.col("event_type").isin("error", "purchase").alias("bad"))
    return C.tune_check(e, _GRID).withColumn("f1", F.round("f1", 9))


@CORE.query(
    "short_report",
    _SUBJECTS + ", r AS (SELECT chars, hits, ('0x' || left(sha256(CAST(id AS VARCHAR)), 2))::INTEGER % 5 = 0 AS held, CASE WHEN id % 3 <> 0 THEN id % 2 = 0 END AS label FROM sub)"
    " SELECT CASE WHEN chars < 50 THEN '0-49' WHEN chars < 200 THEN '50-199' WHEN chars < 800 THEN '200-799' ELSE '800+' END AS bucket, hits > 0 AS tech, count(*) AS n, count_if(label AND NOT held) AS pos, count_if(NOT label AND NOT held) AS neg, count_if(label AND held) AS held_pos, count_if(NOT label AND held) AS held_neg FROM r GROUP BY 1, 2",
)
def short_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subjects(spark, sf_dir).select("chars", "hits", stats.in_holdout(F.col("id")).alias("held"), F.when(F.col("id") % 3 != 0, F.col("id") % 2 == 0).alias("label"))
    return C.bucket_table(s, [(50, "0-49"), (200, "50-199"), (800, "200-799")], "800+")


@CORE.query(
    "compare_scorers",
    "WITH s AS (SELECT event_id, value AS a, value * (1 + event_id % 7) AS b, event_type IN ('error', 'purchase') AS label FROM events), u AS (SELECT 'a' AS scorer, a AS score, label FROM s UNION ALL SELECT 'b', b, label FROM s), r AS (SELECT scorer, label, rank() OVER (PARTITION BY scorer ORDER BY score) + (count(*) OVER (PARTITION BY scorer, score) - 1) / 2.0 AS rk FROM u)"
    " SELECT scorer, round((sum(rk) FILTER (WHERE label) - count_if(label) * (count_if(label) + 1) / 2.0) / (count_if(label) * count_if(NOT label)), 9) AS auc FROM r GROUP BY scorer",
)
def compare_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers on the same labels."""
    e = table(spark, sf_dir, "events")
    label = F.col("event_type").isin("error", "purchase").alias("label")
    one = lambda n, c: C.auc(e.select(c.alias("score"), label)).select(F.lit(n).alias("scorer"), F.round("auc", 9).alias("auc"))
    return one("a", F.col("value")).unionByName(one("b", F.col("value") * (1 + F.col("event_id") % 7)))


@CORE.query(
    "held_out_auc",
    "WITH s AS (SELECT event_id, value AS score, event_type IN ('error', 'purchase') AS label, CASE WHEN ('0x' || left(sha256(CAST(event_id AS VARCHAR)), 2))::INTEGER % 5 = 0 THEN 'held_out' ELSE 'build' END AS slice FROM events), r AS (SELECT slice, label, rank() OVER (PARTITION BY slice ORDER BY score) + (count(*) OVER (PARTITION BY slice, score) - 1) / 2.0 AS rk FROM s)"
    " SELECT slice, round((sum(rk) FILTER (WHERE label) - count_if(label) * (count_if(label) + 1) / 2.0) / (count_if(label) * count_if(NOT label)), 9) AS auc, count_if(label) AS n_pos, count_if(NOT label) AS n_neg FROM r GROUP BY slice",
)
def held_out_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer on the held-out slice and on the rest."""
    e = table(spark, sf_dir, "events").select("value", F.col("event_type").isin("error", "purchase").alias("label"), stats.in_holdout(F.col("event_id")).alias("held"))
    one = lambda n, test: C.auc(e.where(test).select(F.col("value").alias("score"), "label")).select(F.lit(n).alias("slice"), F.round("auc", 9).alias("auc"), "n_pos", "n_neg")
    return one("held_out", F.col("held")).unionByName(one("build", ~F.col("held")))


# ---- vectors


@CORE.query(
    "vector_novelty",
    "WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), j AS (SELECT a.vec_id, b.vec_id AS ref, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM q a JOIN q b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0) SELECT vec_id, arg_max(ref, (c, -ref)) AS nearest, round(max(c), 5) AS similarity FROM j GROUP BY vec_id",
)
def vector_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vector of the same topic, for every query (ids divisible by 20) against all rows."""
    v = spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("v")), "id")
    b = best_match(v.where("id % 20 = 0"), v)
    return b.select(F.col("id").alias("vec_id"), "nearest", F.round("similarity", 5).alias("similarity"))


_NOVEL = "WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT a.vec_id, a.label, max(round(list_cosine_similarity(a.e, b.e), 9)) AS s FROM q a JOIN q b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL)"


@CORE.query(
    "novelty_summary",
    _NOVEL + ", r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS m FROM n), c AS (SELECT DISTINCT k.i, (m + 1) * k.i / 10.0 AS r, m FROM (VALUES (1), (5), (9)) k(i), r), j AS (SELECT i, r, greatest(1, least(CAST(floor(r) AS BIGINT), m - 1)) AS j FROM c)"
    " SELECT CAST(j.i AS BIGINT) AS i, round(a.s + (b.s - a.s) * (j.r - j.j), 6) AS cut, (SELECT count_if(s >= 0.5) FROM n) AS established FROM j JOIN r a ON a.i = j.j JOIN r b ON b.i = j.j + 1",
)
def novelty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenth, half and nine tenths of the similarities, and how many are established."""
    from ..operators.relational import exclusive_quantiles

    v = spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("v")), "id")
    b = settle(best_match(v.where("id % 20 = 0"), v).select(F.col("similarity").alias("s")), "novelty")
    known = F.broadcast(b.agg(F.count_if(F.col("s") >= 0.5).alias("established")))  # one row
    return exclusive_quantiles(b, "s", 10).where("i IN (1, 5, 9)").select("i", F.round("cut", 6).alias("cut")).join(known, F.lit(True))


# ---- recipes

RECIPES = [{"gap": 30, "max": 50, "overlap": 3}, {"gap": 30, "max": 50, "overlap": 0}, {"max": 50, "gap": 30, "overlap": 3}, {"gap": 60, "max": 50, "overlap": 3}]


@CORE.query("chunk_recipes", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (2::BIGINT, 2::BIGINT), (3::BIGINT, 1::BIGINT), (4::BIGINT, 3::BIGINT)) t(no, version)")
def chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each set of parameters: the same parameters are the same recipe."""
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(recipe_versions(RECIPES))], "no long, version long")
