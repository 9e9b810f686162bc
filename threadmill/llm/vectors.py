"""Most similar vectors for every vector, by a block matrix join.

Equal directions are folded into classes first, so that a group of copies is
one row.  Class representatives are dealt into stripes of bounded size, as large
as the number of cores allows, since a vector is sent once per stripe; every
pair of stripes is one tile, and tiles are dealt evenly to a bounded number of
tasks, which work them off one after the other.  In a tile,
int8 products give each cosine with an error bound; only pairs whose upper
bound reaches the row's third best so far are recomputed in double precision,
and each row keeps a heap of its k best.  Rows' heaps of all tiles are merged
at the end.  Nothing is approximate: what the bounds discard cannot be among
the k best.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import settle

#: Rows of a tile that are multiplied at once.
STEP = 1024


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding took from each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


class Heaps:
    """The k best partners of each of n rows: ties go to the smaller partner id."""

    def __init__(self, n: int, k: int):
        self.sim, self.who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.sim[:, -1]

    def merge(self, row: np.ndarray, sim: np.ndarray, who: np.ndarray) -> None:
        """Take in pairs (row, sim, who)."""
        if not len(row):
            return
        k = self.sim.shape[1]
        touched = np.unique(row)
        row = np.concatenate([row, np.repeat(touched, k)])
        sim = np.concatenate([sim, self.sim[touched].ravel()])
        who = np.concatenate([who, self.who[touched].ravel()])
        order = np.lexsort((who, -sim, row))
        row, sim, who = row[order], sim[order], who[order]
        fresh = np.ones(len(row), bool)  # a pair may come twice
        fresh[1:] = (row[1:] != row[:-1]) | (who[1:] != who[:-1])
        row, sim, who = row[fresh], sim[fresh], who[fresh]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        self.sim[row[best], place[best]] = sim[best]
        self.who[row[best], place[best]] = who[best]


def tile(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, k: int, same: bool) -> tuple[Heaps, Heaps]:
    """Heaps of stripe a's rows over b and of b's rows over a (``same``: a is b)."""
    ua, ub = unit_rows(a.astype(np.float64)), unit_rows(b.astype(np.float64))
    (qa, sa, ea), (qb, sb, eb) = quantised(ua), quantised(ub)
    fa, fb = qa.astype(np.float32), qb.astype(np.float32)  # whole numbers below 2^24 stay exact
    ha, hb = Heaps(len(a), k), Heaps(len(b), k)
    slack = 1e-5  # float32 rounding of the scaled product

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 1 << 18):
            x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            keep = ids_a[x] != ids_b[y] if same else slice(None)
            x, y = x[keep], y[keep]
            sim = np.einsum("ij,ij->i", ua[x], ub[y])
            ha.merge(x, sim, ids_b[y])
            if not same:
                hb.merge(y, sim, ids_a[x])

    for at in range(0, len(a), STEP):
        rows = slice(at, min(at + STEP, len(a)))
        n = rows.stop - rows.start
        for bt in range(0, len(b), STEP):
            cols = slice(bt, min(bt + STEP, len(b)))
            upper = (fa[rows] @ fb[cols].T) * sa[rows, None].astype(np.float32) * sb[None, cols].astype(np.float32)
            # |x.y - q.q'| <= |ex| |y| + |q'| |ex|... for unit rows at most ex + ey + ex ey
            upper += (ea[rows, None] + eb[None, cols] * (1 + ea[rows, None]) + slack).astype(np.float32)
            need_a, need_b = ha.floor()[rows], hb.floor()[cols]
            for heap, need, axis in ((ha, need_a, 1), (hb, need_b, 0)) if not same else ((ha, need_a, 1),):
                if np.isinf(need).any():  # no threshold yet: the k+1 best by upper bound start the heaps
                    m = min(k + 1, upper.shape[axis])
                    best = np.argpartition(-upper, m - 1, axis=axis)
                    if axis == 1:
                        pairs(np.repeat(np.arange(n), m) + at, best[:, :m].ravel() + bt)
                    else:
                        pairs(best[:m, :].ravel() + at, np.tile(np.arange(cols.stop - cols.start), m) + bt)
            hit = upper >= ha.floor()[rows, None].astype(np.float32) - np.float32(1e-6)
            if not same:
                hit |= upper >= hb.floor()[None, cols].astype(np.float32) - np.float32(1e-6)
            i, j = np.nonzero(hit)
            pairs(i + at, j + bt)
    return ha, hb


def comparable(vectors: DataFrame, key: str, vector: str, revision: str | None = None) -> DataFrame:
    """One usable vector per key: id, v.

    Left out are null keys, null, empty and all-zero vectors, vectors with
    null or non-finite components, and (if given) other revisions.  Of several
    vectors of one key the greatest by array order counts.
    """
    d = vectors.where(F.col("revision") == revision) if revision is not None else vectors
    v = F.col(vector).cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    d = d.where(F.col(key).isNotNull() & fine).select(F.col(key).alias("id"), v.alias("v"))
    return d.groupBy("id").agg(F.max("v").alias("v"))


def stripes(n: int, cores: int, least: int, most: int) -> int:
    """How many stripes: enough that tiles keep all cores busy (four for each), of ``least`` to ``most`` rows."""
    return max(1, math.ceil(n / most), min(math.ceil(n / least), math.ceil(math.sqrt(8 * cores))))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that hash partitioning puts there."""
    found = spark.range(24 * n + 200).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found, key=lambda r: r["p"])]


def nearest(vectors: DataFrame, k: int = 3, least: int = 6144, most: int = 32_768, tasks: int = 4096) -> DataFrame:
    """The ``k`` most similar others of every vector: id, other_id, sim, place (1 = most similar).

    ``vectors`` has id (unique) and v, as ``comparable`` gives them; only
    vectors of equal length are compared.  Ties go to the smaller id.  Equal
    vectors are folded: of a class the k+1 smallest ids are enough, as any
    member's k best lie among its own class and the k nearest classes.  With
    fewer than k+1 vectors every vector gets all others; an empty table gives
    no row.
    """
    spark = vectors.sparkSession
    classes = vectors.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = settle(classes.withColumn("dim", F.size("v")), "vectors")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = max((stripes(n, spark.sparkContext.defaultParallelism, least, most) for n in sizes.values()), default=1)
    rows = classes.select("dim", "rep", "v", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("long").alias("s"))
    # Each stripe goes to all tiles that it is part of: (lo, hi) with lo <= hi, numbered along the triangle.
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    tiles = rows.withColumn("o", F.explode(every)).withColumn("lo", F.least("s", "o")).withColumn("hi", F.greatest("s", "o"))
    n_tiles = len(sizes) * parts * (parts + 1) // 2
    slots = even_keys(spark, max(1, min(n_tiles, tasks)))
    number = F.expr("hi * (hi + 1) div 2 + lo") + F.col("dim")
    slot = F.element_at(F.array(*(F.lit(x) for x in slots)), (F.pmod(number, F.lit(len(slots))) + 1).cast("int"))
    tiles = tiles.select(slot.alias("slot"), "dim", "lo", "hi", "rep", "v", "s")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[2], key[3]
        a = pdf[pdf.s == lo]
        ids_a, ma = a.rep.to_numpy(np.int64), np.stack(a.v.to_numpy()) if len(a) else np.zeros((0, 1))
        if lo == hi:
            heaps = [(ids_a, tile(ids_a, ma, ids_a, ma, k, True)[0])] if len(a) > 1 else []
        else:
            b = pdf[pdf.s == hi]
            if not len(a) or not len(b):
                heaps = []
            else:
                ids_b, mb = b.rep.to_numpy(np.int64), np.stack(b.v.to_numpy())
                ha, hb = tile(ids_a, ma, ids_b, mb, k, False)
                heaps = [(ids_a, ha), (ids_b, hb)]
        out = [(np.repeat(ids, k), h.who.ravel(), h.sim.ravel()) for ids, h in heaps]
        if not out:
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "sim": np.zeros(0)})
        rep, other, sim = (np.concatenate(x) for x in zip(*out))
        good = np.isfinite(sim)
        return pd.DataFrame({"rep": rep[good], "other": other[good], "sim": sim[good]})

    # Tiles that share a slot come one after the other in one task.
    found = tiles.repartition(len(slots), "slot").groupBy("slot", "dim", "lo", "hi").applyInPandas(run, "rep long, other long, sim double")
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    near = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("rep", "other", "sim")
    near = settle(near, "near")
    # The first ids of every class: enough for all members.
    reps = classes.select("v", "rep", "size")
    members = vectors.join(reps, "v").select("id", "rep", "size")
    heads = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("rep").alias("other"), F.col("id").alias("other_id"))
    alone = members.where(F.col("size") <= k).join(near, "rep").join(heads, "other").select("id", "other_id", "sim")
    own = members.where(F.col("size") > 1).join(heads.withColumnRenamed("other", "rep"), "rep").where(F.col("id") != F.col("other_id")).select("id", "other_id", F.lit(1.0).alias("sim"))
    ranked = alone.unionByName(own).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other_id")))
    return ranked.where(F.col("place") <= k).select("id", "other_id", "sim", "place")


def similar_pairs(vectors: DataFrame, k: int = 3) -> DataFrame:
    """Pairs of which at least one is among the k most similar of the other, smaller id first, once each."""
    near = nearest(vectors, k)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()

