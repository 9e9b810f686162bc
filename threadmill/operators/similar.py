"""Near duplicates by an exact similarity join, and connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .order import numbered


def shingles(text_words, size: int):
    """64-bit hashes of the distinct runs of ``size`` words (the whole text if it has fewer) of an array of words."""
    n = F.size(text_words)
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(text_words, i, size)))
    return F.array_distinct(F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(text_words))).otherwise(F.array().cast("array<bigint>")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, component (its smallest node).

    Every node takes the smallest label around it, then its label's label;
    labels only fall, so rounds end when none does.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("n"), F.col("label").alias("l")), F.col("b") == F.col("n")).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("new"), "label")
        up = step.select(F.col("node").alias("u"), F.col("new").alias("u_new"))
        step = step.join(up, F.col("new") == F.col("u"), "left").select("node", F.least("new", F.coalesce("u_new", "new")).alias("new"), "label")
        step = settle(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def _folded(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sets`` with n and key (null if empty); key, rep and copies of each different set; id, items, n and copies of those."""
    keyed = sets.withColumn("key", F.xxhash64(F.sort_array("items"))).withColumn("n", F.coalesce(F.size("items"), F.lit(0)))
    keyed = settle(keyed.withColumn("key", F.when(F.col("n") > 0, F.struct("key", F.sha2(F.array_join(F.transform(F.sort_array("items"), lambda x: x.cast("string")), "\x1f"), 256).alias("sha")))), "sets")
    some = keyed.where("n > 0")
    groups = some.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = settle(some.join(groups.select(F.col("rep").alias("id"), "copies"), "id").select("id", "items", "n", "copies"), "reps")
    return keyed, groups, reps


def _links(reps: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs of different sets: a, b (a < b), ca, cb (their copies).

    The join is exact: two such sets share one of their first (rarest)
    n - ceil(t n) + 1 items, so only those are joined.  A pair is compared
    where its first shared item meets, inside the join, so that candidates are
    never written: the places of the item and a bitmap of each set bound what
    they can share before the sets themselves are looked at.
    """
    one = reps.select("id", "n", "copies", F.explode("items").alias("item"))
    frequency = one.groupBy("item").agg(F.count("*").alias("f")).where("f > 1").withColumn("h", F.shiftright(F.xxhash64("item"), 8))
    # Items get small numbers, since rows of the join carry their sets; what only one set has counts in n alone.
    number = numbered(frequency, [], ["h", "item"]).select("item", "f", F.col("no").cast("int").alias("no"))
    sets = one.join(number, "item").groupBy("id", "n", "copies").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "no"))), lambda x: x["no"]).alias("w"))
    sets = settle(sets.withColumn("bits", F.expr("aggregate(w, 0L, (s, x) -> s | shiftleft(1L, x % 64))")), "sets")
    prefix = sets.withColumn("k", F.size("w")).select("id", "n", "copies", "w", "bits", "k", F.posexplode(F.slice("w", 1, F.greatest(F.lit(0), F.least(F.col("k"), F.col("k") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)).cast("int"))).alias("at", "item"))
    a, b = prefix.alias("a"), prefix.alias("b")
    least = F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-6
    both = F.array_intersect("a.w", "b.w")  # in the order of a.w
    shared = F.size(both)
    tests = [
        F.col("a.item") == F.col("b.item"),
        F.col("a.id") < F.col("b.id"),
        F.col("a.k") - F.col("a.at") >= least,
        F.col("b.k") - F.col("b.at") >= least,
        F.col("a.k") - F.bit_count(F.col("a.bits").bitwiseAND(F.bitwise_not("b.bits"))) >= least,
        F.col("b.k") - F.bit_count(F.col("b.bits").bitwiseAND(F.bitwise_not("a.bits"))) >= least,
        shared >= F.lit(threshold) * (F.col("a.n") + F.col("b.n") - shared) - 1e-9,
        F.element_at(both, 1) == F.col("a.item"),
    ]
    pairs = a.join(b, reduce(lambda x, y: x & y, tests))
    return settle(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.copies").alias("ca"), F.col("b.copies").alias("cb")), "links")


def similar_links(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Membership (id, rep: the smallest id of an equal set) and similar pairs of representatives (a, b).

    ``sets``: id (unique), items.  Empty and null sets represent themselves.
    """
    keyed, groups, reps = _folded(sets)
    of = keyed.where("n > 0").select("id", "key").join(groups.select("key", "rep"), "key").select("id", "rep")
    return of.unionByName(keyed.where("n = 0").select("id", F.col("id").alias("rep"))), _links(reps, threshold).select("a", "b")


def near_duplicates(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Classes of similar sets: id, class_id, n_links, n_copies.

    ``sets``: id (unique), items (array of distinct strings or hashes).  Two rows are
    linked if the Jaccard similarity of their sets is at least ``threshold``;
    a class is a connected component and named by its smallest id; n_links
    counts the rows of other sets that a row is linked to, n_copies those of
    the same set (itself included).  Equal sets are joined as one row, and
    their classes are not expanded into pairs.  Rows with null or empty sets
    are their own class.
    """
    keyed, groups, reps = _folded(sets)
    links = _links(reps, threshold)
    n_links = links.select(F.col("a").alias("r"), F.col("cb").alias("c")).unionByName(links.select(F.col("b").alias("r"), F.col("ca").alias("c"))).groupBy("r").agg(F.sum("c").alias("n_links"))
    comp = components(links.select("a", "b")).select(F.col("node").alias("c_rep"), "component")
    of_rep = groups.join(comp, F.col("rep") == F.col("c_rep"), "left").join(n_links, F.col("rep") == F.col("r"), "left")
    of_rep = of_rep.select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    out = keyed.where("n > 0").select("id", "key").join(of_rep, F.col("key") == F.col("k")).select("id", "class_id", "n_links", "n_copies")
    return out.unionByName(keyed.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
