"""From extracted statements to what is published: validation, exclusion, corrections, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Reviews that reject a statement.
REJECTED = ("wrong", "made_up", "not_useful")


def validate(claims: DataFrame, messages: DataFrame, names: DataFrame) -> DataFrame:
    """Extracted statements with what is wrong with them: claim, problem (null: accepted).

    ``claims``: claim, xid, speaker (an author's id), statement, refs (message
    ids); ``messages``: xid, id, author_id; ``names``: xid, name.  Problems in
    this order: empty statement, no refs, unknown ref (one that isn't in the
    exchange), unknown speaker (nobody of the exchange), name leak (a name of
    the exchange as a whole word, in any case).  Null refs count as none.
    """
    refs = claims.select("claim", "xid", F.explode("refs").alias("ref"))
    there = messages.select(F.col("xid").alias("m_xid"), F.col("id").alias("m_id"))
    bad = refs.join(there, (F.col("xid") == F.col("m_xid")) & (F.col("ref") == F.col("m_id")), "left_anti").select(F.col("claim").alias("b_claim")).distinct()
    known = messages.select(F.col("xid").alias("s_xid"), F.col("author_id").alias("s_author")).distinct()
    held = names.where("name IS NOT NULL").select(F.col("xid").alias("n_xid"), F.lower("name").alias("name")).groupBy("n_xid").agg(F.collect_set("name").alias("names"))
    text = F.concat(F.lit(" "), F.lower("statement"), F.lit(" "))
    # A name as a whole word: what stands around it is no word character.
    edge = lambda c: ~F.coalesce(c.rlike(r"[\p{L}\p{N}_]"), F.lit(False))

    def leaks(name: Column) -> Column:
        parts = F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1)
        return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: (F.size(parts) > 1) & edge(F.right(F.get(parts, i - 1), F.lit(1))) & edge(F.left(F.get(parts, i), F.lit(1))))

    j = claims.join(bad, F.col("claim") == F.col("b_claim"), "left").join(known, (F.col("xid") == F.col("s_xid")) & (F.col("speaker") == F.col("s_author")), "left").join(held, F.col("xid") == F.col("n_xid"), "left")
    problem = (
        F.when(~T.has_text(F.col("statement")), "empty statement")
        .when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "no refs")
        .when(F.col("b_claim").isNotNull(), "unknown ref")
        .when(F.col("s_author").isNull(), "unknown speaker")
        .when(F.coalesce(F.exists("names", leaks), F.lit(False)), "name leak")
    )
    return j.select("claim", problem.alias("problem"))


def publishable(review: Column, verdict: Column, allowed: tuple[str, ...] | None) -> Column:
    """Rejected reviews never, good ones always, others by their verdict (none: unchecked); all if ``allowed`` is None."""
    if allowed is None:
        return ~F.coalesce(review.isin(*REJECTED), F.lit(False))
    return F.when(review.isin(*REJECTED), False).when(review == "good", True).otherwise(F.coalesce(verdict, F.lit("unchecked")).isin(*allowed))


def has_tech(hits: Column, topics: Column) -> Column:
    """A lexicon hit or any topic."""
    return (F.coalesce(F.size(hits), F.lit(0)) > 0) | (F.coalesce(F.size(topics), F.lit(0)) > 0)


def corrected(claims: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements after corrections, with ``dropped``; and the corrections that fit nothing.

    ``corrections``: xid, statement, replace (null: drop), unique by exchange
    and statement.
    """
    c = corrections.select(F.col("xid").alias("c_xid"), F.col("statement").alias("c_statement"), "replace", F.lit(True).alias("hit"))
    same = (F.col("xid") == F.col("c_xid")) & (F.col("statement") == F.col("c_statement"))
    j = claims.join(c, same, "left")
    dropped = F.col("hit").isNotNull() & F.col("replace").isNull()
    out = j.select(*(x for x in claims.columns if x != "statement"), F.coalesce("replace", "statement").alias("statement"), dropped.alias("dropped"))
    unmatched = c.join(claims.select("xid", "statement"), same, "left_anti").select(F.col("c_xid").alias("xid"), F.col("c_statement").alias("statement"))
    return out, unmatched


def exclusion(dropped_speaker: Column, review: Column, verdict: Column, dropped: Column, tech: Column, allowed: tuple[str, ...]) -> Column:
    """Why a statement isn't published (null: it is): speaker, review, check:<verdict>, corrected, no_tech; the first that holds."""
    return (
        F.when(dropped_speaker, "speaker").when(review.isin(*REJECTED), "review")
        .when(~publishable(review, verdict, allowed), F.concat(F.lit("check:"), F.coalesce(verdict, F.lit("unchecked"))))
        .when(dropped, "corrected").when(~tech, "no_tech")
    )


def first_of_each(claims: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order``."""
    rest = [c for c in claims.columns if c not in keys]
    top = claims.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("t"))
    return top.select(*keys, *(F.col(f"t.{c}").alias(c) for c in rest))


def live(claims: DataFrame) -> DataFrame:
    """Statements that stand: of live runs, not retracted, not known already, and replaced by no such statement.

    ``claims``: claim, mode, retracted_at, novelty, supersedes.
    """
    alive = (F.col("mode") == "live") & F.col("retracted_at").isNull()
    newer = claims.where(alive & F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("s_claim"))
    return claims.where(alive & (F.col("novelty") != "known")).join(newer, F.col("claim") == F.col("s_claim"), "left_anti")


def speakers(claims: DataFrame, members: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whose statement each is, by the exchange's pseudonyms computed anew: claim, author_id (null: unknown), is_dropped; and the exchanges in which someone isn't dropped: xid.

    ``claims``: claim, xid, speaker (pseudonym); ``members``: xid, author_id,
    pseudonym; ``dropped``: author_id.
    """
    gone = dropped.select(F.col("author_id").alias("d_author")).distinct()
    m = members.join(gone, F.col("author_id") == F.col("d_author"), "left").select(F.col("xid").alias("m_xid"), "pseudonym", "author_id", F.col("d_author").isNotNull().alias("is_dropped"))
    out = claims.join(m, (F.col("xid") == F.col("m_xid")) & (F.col("speaker") == F.col("pseudonym")), "left").select("claim", "author_id", F.coalesce("is_dropped", F.lit(False)).alias("is_dropped"))
    return out, m.where("NOT is_dropped").select(F.col("m_xid").alias("xid")).distinct()


def corroboration(groups: DataFrame) -> DataFrame:
    """Groups by their number of distinct speakers (1, 2, 3+): speakers, groups, claims.  ``groups``: topic, lead, claim, speaker."""
    g = groups.groupBy("topic", "lead").agg(F.count("*").alias("n"), F.count_distinct("speaker").alias("s"))
    return g.groupBy(F.when(F.col("s") >= 3, "3+").otherwise(F.col("s").cast("string")).alias("speakers")).agg(F.count("*").alias("groups"), F.sum("n").alias("claims"))


def origins(annotations: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """The stage that decided each exchange in its latest run: xid, origin.

    ``annotations``: xid, stage, label, run_at.  Of the latest run's rows with
    a label the last in the order of ``stages`` counts; residue is undecided.
    """
    order = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage"))
    last = annotations.groupBy("xid").agg(F.max("run_at").alias("l_at")).withColumnRenamed("xid", "l_xid")
    a = annotations.join(last, (F.col("xid") == F.col("l_xid")) & (F.col("run_at") == F.col("l_at"))).where(F.col("label").isNotNull() & (order > 0))
    return a.groupBy("xid").agg(F.max_by("stage", order).alias("s")).select("xid", F.when(F.col("s") == "residue", "undecided").otherwise(F.col("s")).alias("origin"))


def pooled_rerank(rows: DataFrame, first: list[Column], pool: int, then: list[Column], n: int) -> DataFrame:
    """The best ``n`` by one order among the first ``pool`` of another (both are the feature)."""
    return rows.orderBy(*first).limit(pool).orderBy(*then).limit(n)


def size_matched(available: DataFrame, wanted: DataFrame, bucket: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows of ``available`` in the size mix of ``wanted``: largest remainders, never more than a bucket holds.

    Buckets are few; within one the first rows along ``order`` are taken.
    Places that a bucket can't fill go to the others by their remainder.
    """
    mix = wanted.groupBy(bucket).agg(F.count("*").alias("w"))
    have = available.groupBy(F.col(bucket).alias("h_bucket")).agg(F.count("*").alias("h"))
    rows = sorted(mix.join(have, F.col(bucket).eqNullSafe(F.col("h_bucket")), "left").select(bucket, "w", F.coalesce("h", F.lit(0)).alias("h")).collect(), key=lambda r: str(r[0]))
    total = sum(r["w"] for r in rows)
    share = {r[0]: n * r["w"] / total for r in rows} if total else {}
    take = {r[0]: min(int(share[r[0]]), r["h"]) for r in rows} if total else {}
    places = {r[0]: int(share[r[0]]) for r in rows} if total else {}
    while sum(take.values()) < n:
        room = [r for r in rows if take[r[0]] < r["h"]] if total else []
        if not room:
            break
        best = max(room, key=lambda r: (share[r[0]] - places[r[0]], str(r[0])))[0]
        places[best] += 1
        take[best] += 1
    ranked = available.withColumn("__rn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("__rn") <= n)
    keep = F.lit(False)
    for b, k in take.items():
        keep = keep | (F.col(bucket).eqNullSafe(F.lit(b)) & (F.col("__rn") <= k))
    return ranked.where(keep).drop("__rn")


def redact_names(messages: DataFrame, members: DataFrame, common: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Texts in which the exchange's author names are replaced by pseudonyms: id, text, n_names.

    ``messages``: xid, id, content; ``members``: xid, author_id, pseudonym,
    name.  A name counts whole and by its words of ``least`` or more letters
    that aren't ``common``, in any case, as a whole word, with an @ before it or
    not; longer ones first.  Exchanges are of bounded size, so are their names.
    """
    parts = F.array_distinct(F.concat(F.array(F.trim("name")), F.split(F.trim("name"), r"\s+")))
    t = members.where("name IS NOT NULL").select("xid", "author_id", "pseudonym", F.explode(parts).alias("p")).withColumn("p", F.lower("p"))
    t = t.where((F.length("p") >= least) & (~F.col("p").isin(*common) if common else F.lit(True)))
    # A word of two authors' names stands for the first of them.
    t = t.groupBy("xid", "p").agg(F.min_by("pseudonym", "author_id").alias("to"))
    by = t.groupBy(F.col("xid").alias("t_xid")).agg(F.sort_array(F.collect_list(F.struct((-F.length("p")).alias("l"), "p", "to"))).alias("names"))
    j = messages.join(by, F.col("xid") == F.col("t_xid"), "left")

    def put(text: Column, n: Column) -> Column:
        # Pseudonyms hold a hyphen and digits and are marked, so that no later name is found inside one.
        pattern = F.concat(F.lit(r"(?iu)@?(?<![\p{L}\p{N}_])\Q"), n["p"], F.lit(r"\E(?![\p{L}\p{N}_])"))
        return F.regexp_replace(text, pattern, F.concat(F.lit("\x02"), n["to"].substr(6, 99), F.lit("\x03")))

    empty = F.array().cast("array<struct<l:int,p:string,to:string>>")
    text = F.aggregate(F.coalesce("names", empty), F.coalesce("content", F.lit("")), put)
    j = j.select("id", text.alias("t"))
    return j.select("id", F.regexp_replace("t", "\x02([^\x03]*)\x03", "user-$1").alias("text"), F.regexp_count("t", F.lit("\x02")).cast("long").alias("n_names"))
