"""Joins, windows and rankings that the archive's queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .order import carried, numbered, prefix_sums, same_keys


def as_of(probes: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, value: str, tie: str) -> DataFrame:
    """``probes`` with ``value``: that of the latest version of their keys with since <= at (ties: greatest ``tie``).

    Probes and versions are laid into one sequence per key, where the last
    version seen is carried on; no pair of rows is built and no window holds a
    whole key.  ``at`` and ``since`` are whole numbers.  Null where no version
    is old enough, and for probes without a time.
    """
    null = lambda c, f: F.lit(None).cast(dict(f.dtypes)[c])
    v = versions.select(*keys, F.col(since).alias("__at"), F.lit(0).alias("__probe"), F.col(tie).cast("long").alias("__tie"), F.struct(F.col(value).alias("v")).alias("__v"), *(null(c, probes).alias(c) for c in probes.columns if c not in keys))
    p = probes.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__probe"), F.lit(None).cast("long").alias("__tie"), F.lit(None).cast(v.schema["__v"].dataType).alias("__v"), *(c for c in probes.columns if c not in keys))
    j = numbered(settle(v.unionByName(p).where("__at IS NOT NULL"), "asof"), keys, ["__at", "__probe", "__tie"])
    j = carried(settle(j, "asof"), keys, F.col("__probe") == 0, "__since")
    last = j.where("__probe = 0").select(*(F.col(k).alias(f"v_{k}") for k in keys), F.col("no").alias("v___since"), F.col("__v.v").alias("v_value"))
    out = j.where("__probe = 1").join(last, same_keys([*keys, "__since"], "v_") & F.col("__since").isNotNull(), "left").select(*probes.columns, F.col("v_value").alias(value))
    lost = probes.where(F.col(at).isNull()).select(*probes.columns, F.lit(None).cast(dict(out.dtypes)[value]).alias(value))
    return out.unionByName(lost)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key, with ``place`` (1-based)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def latest_state(events: DataFrame, key: str, order: list[str], value: str, keep: tuple[str, ...]) -> DataFrame:
    """Latest value per key, if it is one of ``keep`` (any other latest value erases)."""
    last = events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return last.where(F.col(value).isin(*keep))


def index_quantile(df: DataFrame, keys: list[str], value: str, index: Column) -> DataFrame:
    """The value at a 0-based place of each key's sorted values; ``index`` may use n, the key's count.

    Works on counts of distinct values, so a key with many rows is not sorted
    as a whole.
    """
    c = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    c = prefix_sums(c.where(F.col(value).isNotNull()), keys, value, ["c"]).withColumnRenamed("c_upto", "upto")
    n = df.where(F.col(value).isNotNull()).groupBy(*(F.col(k).alias(f"o_{k}") for k in keys)).agg(F.count("*").alias("n"))
    c = c.join(n, same_keys(keys))
    i = index
    return c.where((F.col("upto") > i) & (F.col("upto") - F.col("c") <= i)).select(*keys, F.col(value).alias("quantile"))


def exclusive_quantiles(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n-1 cut points of n equal parts, interpolated at ranks (m+1)*i/n: i, cut."""
    c = df.groupBy(value).agg(F.count("*").alias("c"))
    c = settle(prefix_sums(c.where(F.col(value).isNotNull()), [], value, ["c"]).withColumnRenamed("c_upto", "upto"), "quantiles")
    m = F.broadcast(df.agg(F.count(value).alias("m")))
    cuts = m.select("m", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("i")).withColumn("r", (F.col("m") + 1) * F.col("i") / n)
    cuts = cuts.withColumn("j", F.greatest(F.lit(1), F.least(F.floor("r"), F.col("m") - 1))).withColumn("f", F.col("r") - F.col("j"))
    lo, hi = c.select(F.col(value).alias("a"), F.col("upto").alias("ua"), F.col("c").alias("ca")), c.select(F.col(value).alias("b"), F.col("upto").alias("ub"), F.col("c").alias("cb"))
    inside = lambda j, u, k: (F.col(u) >= j) & (F.col(u) - F.col(k) < j)
    # n-1 rows against the counts of distinct values.
    out = F.broadcast(cuts).join(lo, inside(F.col("j"), "ua", "ca")).join(hi, inside(F.col("j") + 1, "ub", "cb"))
    return out.select(F.col("i").cast("long").alias("i"), (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("cut"))


def largest_remainder(strata: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """n places divided in proportion to size: key, places.  Ties of fractions go to the smaller key."""
    total = F.broadcast(strata.agg(F.sum(size).alias("total")))
    s = strata.join(total, F.lit(True)).withColumn("exact", F.col(size) * n / F.col("total"))
    s = s.withColumn("base", F.floor("exact")).withColumn("frac", F.round(F.col("exact") - F.col("base"), 9))
    rank = F.row_number().over(Window.orderBy(F.desc("frac"), key))
    s = s.withColumn("rank", rank).withColumn("rest", F.lit(n) - F.sum("base").over(Window.partitionBy()))
    return s.select(key, (F.col("base") + F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("places"))


def round_robin(rows: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """n rows dealt one per stratum and pass, in the strata's order: the rows with ``pass``."""
    w = Window.partitionBy(stratum).orderBy(*order)
    # No stratum gives more than n rows: the limit applies before the shuffle.
    return rows.withColumn("pass", F.row_number().over(w)).where(F.col("pass") <= n).orderBy("pass", stratum).limit(n)


def neighbours(messages: DataFrame) -> DataFrame:
    """Every message of an exchange with what stands before and after it."""
    w = Window.partitionBy("xid").orderBy("position")
    n = F.count("*").over(Window.partitionBy("xid"))
    prev_author = F.lag("author_id").over(w)
    return messages.select(
        "xid",
        "position",
        "id",
        n.alias("size"),
        F.coalesce(prev_author == F.col("author_id"), F.lit(False)).alias("same_author"),
        F.coalesce(F.lag("content").over(w).rlike(r"\?\s*$"), F.lit(False)).alias("after_question"),
        F.lag("id").over(w).alias("prev_id"),
        F.lead("id").over(w).alias("next_id"),
    )


def position_bucket(position: Column, size: Column) -> Column:
    """first, last, early (within the first third) or middle."""
    third = F.greatest(F.lit(1), F.floor(size / 3))
    return F.when((size <= 1) | (position <= 0), "POS_first").when(position >= size - 1, "POS_last").when(position <= third, "POS_early").otherwise("POS_middle")


def answered(messages: DataFrame, least: int = 40) -> DataFrame:
    """Exchanges in which a question got an answer of some length by someone else: xid.

    Per exchange and author the first question's place and the last long
    message's place are enough: a question is answered if anyone else's last
    long message stands behind it.
    """
    by = messages.groupBy("xid", "author_id").agg(
        F.min(F.when(F.col("content").contains("?"), F.col("position"))).alias("asked"),
        F.max(F.when(F.length(F.trim("content")) >= least, F.col("position"))).alias("said"),
    )
    # The two authors with the latest long messages decide for everybody.
    top = by.where("said IS NOT NULL").groupBy("xid").agg(F.max(F.struct("said", "author_id")).alias("a"))
    second = by.where("said IS NOT NULL").join(top, "xid").where("author_id <> a.author_id").groupBy("xid").agg(F.max("said").alias("b"))
    j = by.where("asked IS NOT NULL").join(top, "xid").join(second, "xid", "left")
    other = F.when(F.col("author_id") != F.col("a.author_id"), F.col("a.said")).otherwise(F.col("b"))
    return j.where(F.col("asked") < other).select("xid").distinct()


def growth(rows: DataFrame, topic: str, order: list[str], least: int) -> DataFrame:
    """Per topic the order values of its first and its ``least``-th row: topic, first, reached, n."""
    w = Window.partitionBy(topic).orderBy(*order)
    # Only the first rows of a topic are sorted; all are counted.
    r = rows.select(topic, *order).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= least)
    reached = r.where(F.col("rn") == least).select(F.col(topic).alias("o_topic"), F.col(order[0]).alias("reached"))
    g = rows.groupBy(topic).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"))
    return g.join(reached, F.col(topic).eqNullSafe(F.col("o_topic")), "left").select(topic, "first", "reached", "n")


def halves(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with half: 1 for the first half of a key's rows along ``order`` (the larger one if they are odd), else 2."""
    n = rows.groupBy(F.col(key).alias("o_key")).agg(F.count("*").alias("__n"))
    j = numbered(rows, [key], [order]).join(n, F.col(key).eqNullSafe(F.col("o_key")))
    return j.select(*rows.columns, F.when(F.col("no") < F.ceil(F.col("__n") / 2), 1).otherwise(2).alias("half"))


def universal(rows: DataFrame, key: str, test: Column) -> DataFrame:
    """Keys all of whose rows pass a test (null counts as failing): key, n."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.every(F.coalesce(test, F.lit(False))).alias("ok")).where("ok").drop("ok")
