"""Labels derived from what is cited, controls for checks, and a two-model ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import classify as C
from ..operators import stores
from ..operators.grouping import windows_of
from ..operators.relational import halves
from ..storage import settle, table
from .base import SQL_EM, exchange_messages
from .claims_queries import _REPLIES, _replies
from .registry import CORE
from .text_queries import SQL_CLAIM


@CORE.query(
    "citation_labels",
    f"WITH {SQL_EM}, cited AS (SELECT DISTINCT reply_to_id FROM em WHERE reply_to_id IS NOT NULL), live AS (SELECT xid FROM em GROUP BY xid HAVING count(*) >= 3) SELECT id, CASE WHEN id IN (SELECT reply_to_id FROM cited) THEN 'keep' ELSE 'trash' END AS label FROM em WHERE xid IN (SELECT xid FROM live)",
)
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of three or more messages count as worked off, replies as citations."""
    em = exchange_messages(spark, sf_dir).select("xid", "id", "reply_to_id")
    return stores.citation_labels(em, em.groupBy("xid").agg(F.count("*").alias("n")).where("n >= 3"), em.select(F.col("reply_to_id").alias("id")))


_NOVELTY = "CASE {0} % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'partial' WHEN 4 THEN NULL ELSE 'known' END"


@CORE.query(
    "derived_labels",
    f"WITH {SQL_EM}, cl AS (SELECT xid, {_NOVELTY.format('id')} AS novelty FROM em WHERE contains(content, '?')), g AS (SELECT xid, bool_or(coalesce(novelty IN ('unknown', 'partial', 'contradicts'), false)) AS fresh, bool_and(coalesce(novelty = 'known', false)) AS known FROM cl GROUP BY xid),"
    " r AS (SELECT DISTINCT xid, xid % 19 = 0 AS failed FROM em) SELECT xid, CASE WHEN failed THEN NULL WHEN coalesce(fresh, false) THEN 'relevant' WHEN coalesce(known, true) THEN 'irrelevant' END AS label, CASE WHEN failed THEN 'failed run' WHEN NOT coalesce(fresh, false) AND NOT coalesce(known, true) THEN 'unprobed claims' END AS reason FROM r LEFT JOIN g USING (xid)",
)
def derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per exchange; its questions stand in for statements."""
    em = exchange_messages(spark, sf_dir)
    runs = em.select(F.col("xid").alias("run"), "xid", (F.col("xid") % 19 == 0).alias("failed")).distinct()
    claims = em.where(F.col("content").contains("?")).select(F.col("xid").alias("run"), F.expr(_NOVELTY.format("id")).alias("novelty"))
    return stores.labels_of_runs(runs, claims).select("xid", "label", "reason")


_STORE = f"WITH {SQL_EM}, st AS (SELECT DISTINCT xid AS subject, 'rules' AS scorer, v AS version, ((xid // v) % 100) / 100.0 AS score FROM em, (VALUES (1), (2), (3)) t(v) WHERE xid % v = 0)"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exchange_messages(spark, sf_dir).select(F.col("xid").alias("subject")).distinct().withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("subject % version = 0")
    s = x.select("subject", F.lit("rules").alias("scorer"), "version", F.lit(True).alias("derived"), F.lit("{}").alias("recipe"), (F.expr("(subject div version) % 100") / 100.0).alias("score"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("at"))
    return stores.append_annotations(s.limit(0), s)


@CORE.query("active_scores", _STORE + " SELECT subject, version, score FROM st WHERE version = 2")
def active_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the version that was activated last."""
    a = spark.createDataFrame([("rules", 3, 10, 1), ("rules", 1, 20, 2), ("rules", 2, 20, 3)], "scorer string, version int, at long, no long")
    return stores.active_scores(_store(spark, sf_dir), a).select("subject", "version", "score")


@CORE.query("stale_scores", _STORE + " SELECT DISTINCT xid AS subject FROM em WHERE xid NOT IN (SELECT subject FROM st WHERE version = 3)")
def stale_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exchange_messages(spark, sf_dir).select(F.col("xid").alias("subject")).distinct()
    return stores.stale_subjects(s, _store(spark, sf_dir), "rules", "3")


_CLAIM_OVERLAP = f"""len(list_intersect({SQL_CLAIM.replace('@c', 'statement')}, {SQL_CLAIM.replace('@c', '{s}')})) / greatest(1, len({SQL_CLAIM.replace('@c', 'statement')}))"""


def _share(statement: str, source: str):
    a, b = T.claim_tokens(F.col(statement)), T.claim_tokens(F.col(source))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


@CORE.query(
    "negative_controls",
    _REPLIES
    + ", h AS (SELECT *, id % 64 AS part, sha256('c:' || id) AS o FROM r), p AS (SELECT *, coalesce(lead(source) OVER w, first_value(source) OVER w) AS other FROM h WINDOW w AS (PARTITION BY part ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    + " SELECT count(*) AS n, count_if("
    + _CLAIM_OVERLAP.replace("{s}", "source")
    + " >= 0.25) AS supported, count_if("
    + _CLAIM_OVERLAP.replace("{s}", "other")
    + " >= 0.25) AS by_chance FROM p",
)
def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often statements pass against their own source and against another's, dealt by hash in 64 parts."""
    r = _replies(spark, sf_dir).withColumn("part", F.col("id") % 64).withColumn("o", stats.hash_order("c", F.col("id")))
    w = Window.partitionBy("part").orderBy("o")
    other = F.coalesce(F.lead("source").over(w), F.first("source").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = r.withColumn("other", other)
    return p.agg(F.count("*").alias("n"), F.count_if(_share("statement", "source") >= 0.25).alias("supported"), F.count_if(_share("statement", "other") >= 0.25).alias("by_chance"))


@CORE.query(
    "kept_sentences",
    _REPLIES
    + f", t AS (SELECT CASE WHEN source = '' THEN 'no_citation' WHEN len({SQL_CLAIM.replace('@c', 'statement')}) < 3 THEN 'too_short' WHEN "
    + _CLAIM_OVERLAP.replace("{s}", "source")
    + " < 0.25 THEN 'overlap' ELSE 'kept' END AS reason FROM r) SELECT reason, count(*) AS n FROM t GROUP BY reason",
)
def kept_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir)
    reason = F.when(F.col("source") == "", "no_citation").when(F.size(T.claim_tokens(F.col("statement"))) < 3, "too_short").when(_share("statement", "source") < 0.25, "overlap").otherwise("kept")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@CORE.query(
    "value_halves",
    f"WITH d AS (SELECT source, doc_id, ntile(2) OVER (PARTITION BY source ORDER BY doc_id) AS half, {SQL_CLAIM.replace('@c', 'text')} AS w FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), f AS (SELECT source, word, min(half) AS half FROM (SELECT source, half, unnest(w) AS word FROM d) GROUP BY ALL) SELECT source, count_if(half = 1) AS first_half, count_if(half = 2) AS second_half FROM f GROUP BY source",
)
def value_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each half of a source brings for the first time."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    half = halves(d.select("source", "doc_id"), "source", "doc_id").select(F.col("doc_id").alias("h_id"), "half")
    w = d.join(half, F.col("doc_id") == F.col("h_id")).select("source", "half", F.explode(T.claim_tokens(F.col("text"))).alias("word"))
    f = w.groupBy("source", "word").agg(F.min("half").alias("half"))
    return f.groupBy("source").agg(F.count_if(F.col("half") == 1).alias("first_half"), F.count_if(F.col("half") == 2).alias("second_half"))


@CORE.query(
    "char_windows",
    """WITH RECURSIVE l AS (SELECT doc_id, no, line, greatest(1, ceil(length(line) / 600.0))::BIGINT AS k FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents)),
p AS (SELECT doc_id, length(substring(line, CAST(600 * i + 1 AS BIGINT), 600)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY no, i) AS seq FROM (SELECT *, unnest(range(0, k)) AS i FROM l)),
w AS (SELECT doc_id, seq, n, CAST(0 AS BIGINT) AS window_no, n + 1 AS used FROM p WHERE seq = 1
  UNION ALL SELECT p.doc_id, p.seq, p.n, CASE WHEN used + p.n + 1 > 600 THEN window_no + 1 ELSE window_no END, CASE WHEN used + p.n + 1 > 600 THEN 0 ELSE used END + p.n + 1 FROM w JOIN p ON p.doc_id = w.doc_id AND p.seq = w.seq + 1)
SELECT doc_id, window_no, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS chars FROM w GROUP BY doc_id, window_no""",
)
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text packed into windows of 600 characters, longer lines cut: doc_id, window_no, n_lines, chars."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(d, i, len(w), sum(map(len, w))) for d, t in zip(f["doc_id"], f["text"]) for i, w in enumerate(windows_of((t or "").split("\n"), 600))]
            yield pd.DataFrame(rows, columns=["doc_id", "window_no", "n_lines", "chars"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, window_no long, n_lines long, chars long")


@CORE.query("message_ensemble")
def message_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two naive Bayes models joined by a logistic combiner: id, p.

    One learns which messages are cited, the other which stand in relevant
    exchanges.  Every message is scored by models that didn't learn from its
    half, and the combiner is fitted to citations on such scores (logits
    clipped to +-10) of all messages with a label.
    """
    em = exchange_messages(spark, sf_dir)
    m = settle(em.select("id", T.word_tokens(F.col("content")).alias("tokens")), "tokens")
    cited = settle(citation_labels(spark, sf_dir).select("id", (F.col("label") == "keep").alias("label")), "cited")
    relevant = em.select("id", "xid").join(derived_labels(spark, sf_dir).where("label IS NOT NULL").select("xid", (F.col("label") == "relevant").alias("label")), "xid").select("id", "label")
    a, b = (C.out_of_fold_bayes(m, labels).select("id", C.logit(F.col("p")).alias(n)) for labels, n in ((cited, "z0"), (relevant, "z1")))
    both = settle(a.join(b, "id"), "scores")
    fitted = C.fit_logistic_rows(both.join(cited, "id"), ["z0", "z1"])
    if fitted is None:
        return both.select("id", F.lit(0.5).alias("p"))
    w, k = fitted
    z = F.col("z0") * float(w[0]) + F.col("z1") * float(w[1]) + float(k)
    return both.select("id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


@CORE.query(
    "reply_overlap_top",
    _REPLIES + " SELECT id, round(" + _CLAIM_OVERLAP.replace("{s}", "source") + ", 9) AS share FROM r ORDER BY share DESC, id LIMIT 25",
)
def reply_overlap_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir)
    return r.select("id", F.round(_share("statement", "source"), 9).alias("share")).orderBy(F.desc("share"), "id").limit(25)

