"""Append-only stores and labels derived from what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .current import latest_by


class Conflict(Exception):
    """Rows that the store must not take."""


def append_annotations(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new annotations; nothing is ever overwritten.

    Both: subject, scorer, version, derived (boolean), recipe, score, label,
    at.  Conflict if a derived row has no recipe, or one subject would get a
    second derived row of one scorer and version.
    """
    derived = new.where(F.coalesce("derived", F.lit(False)))
    bare = derived.where(F.col("recipe").isNull()).count()
    if bare:
        raise Conflict(f"{bare} derived rows without a recipe")
    key = ["subject", "scorer", "version"]
    own = derived.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    old = derived.join(store.where(F.coalesce("derived", F.lit(False))).select(*key), key, "left_semi").select(*key)
    twice = own.unionByName(old).limit(5).collect()
    if twice:
        raise Conflict("scored already: " + ", ".join(str(tuple(r)) for r in twice))
    return store.unionByName(new.select(*store.columns))


def active_scores(store: DataFrame, activations: DataFrame) -> DataFrame:
    """The scores that count: subject, scorer, version, score of each scorer's active version.

    ``activations``: scorer, version, at, no; the latest counts (ties: the
    greatest no).  A scorer without an activation has none.
    """
    a = latest_by(activations, ["scorer"], ["at", "no"], ["version"]).select(F.col("scorer").alias("a_scorer"), F.col("version").alias("a_version"))
    j = store.join(a, (F.col("scorer") == F.col("a_scorer")) & (F.col("version") == F.col("a_version"))).where("score IS NOT NULL")
    return latest_by(j, ["subject", "scorer", "version"], ["at"], ["score"])


def stale_subjects(subjects: DataFrame, store: DataFrame, scorer: str, version: str) -> DataFrame:
    """Subjects without a score of the given version: subject."""
    done = store.where((F.col("scorer") == scorer) & (F.col("version") == version)).select("subject")
    return subjects.select("subject").join(done, "subject", "left_anti")


def labels_of_runs(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """What runs say of their exchanges: run, xid, label or reason.

    ``runs``: run, xid, failed; ``claims``: run, novelty.  Relevant if any
    statement is new (unknown, partial or contradicts), irrelevant if all are
    known or there are none; a failed run and one with statements nobody
    probed (null or other) give a reason instead.
    """
    fresh = F.coalesce(F.col("novelty").isin("unknown", "partial", "contradicts"), F.lit(False))
    c = claims.groupBy(F.col("run").alias("c_run")).agg(F.bool_or(fresh).alias("fresh"), F.bool_and(F.coalesce(F.col("novelty") == "known", F.lit(False))).alias("known"))
    j = runs.join(c, F.col("run") == F.col("c_run"), "left")
    failed, new, known = F.coalesce("failed", F.lit(False)), F.coalesce("fresh", F.lit(False)), F.coalesce("known", F.lit(True))
    label = F.when(failed, None).when(new, "relevant").when(known, "irrelevant")
    reason = F.when(failed, "failed run").when(~new & ~known, "unprobed claims")
    return j.select("run", "xid", label.alias("label"), reason.alias("reason"))


def citation_labels(messages: DataFrame, worked: DataFrame, cited: DataFrame) -> DataFrame:
    """Messages of worked-off exchanges: id, label (keep if something cites them, else trash).

    ``messages``: xid, id; ``worked``: xid; ``cited``: id.
    """
    c = cited.where("id IS NOT NULL").select(F.col("id").alias("c_id")).distinct()
    m = messages.join(worked.select("xid").distinct(), "xid", "left_semi").join(c, F.col("id") == F.col("c_id"), "left")
    return m.select("id", F.when(F.col("c_id").isNotNull(), "keep").otherwise("trash").alias("label"))


def refreshed_index(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """An inverted index (id, term, tf) after changes: rows of changed ids (id) leave, those of ``fresh`` come."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").unionByName(fresh.select(*index.columns))
