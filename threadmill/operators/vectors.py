"""Searching vectors: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in rows]) if len(rows) else np.zeros((0, 0))
    n = np.linalg.norm(m, axis=1, keepdims=True) if m.size else np.ones((len(rows), 1))
    return m / np.where(n > 0, n, 1)


def best_match(queries: DataFrame, rows: DataFrame, block: int = 20_000) -> DataFrame:
    """The most similar other row of each query's group by cosine: id, nearest, similarity.

    Both have id, group and v (vectors of one length; null vectors are left
    out, zero ones resemble nothing more than 0).  Queries are sent in blocks
    of bounded size; a pass over the rows multiplies them in batches and keeps
    one row per batch and query, so no pair is ever a row.  Ties (to nine
    places) go to the smaller id.  A query alone in its group has no row.
    """
    spark = rows.sparkSession
    q = settle(queries.where("v IS NOT NULL AND id IS NOT NULL").select("id", "group", "v"), "queries")
    n = q.count()
    parts = max(1, -(-n // block))
    every = None
    for p in range(parts):
        part = q.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toPandas()
        held = spark.sparkContext.broadcast({g: (f["id"].to_numpy(np.int64), _unit(list(f["v"]))) for g, f in part.groupby("group", dropna=False)})

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for g, some in f.groupby("group", dropna=False):
                    if g not in held.value:
                        continue
                    ids, mine = held.value[g]
                    some = some.sort_values("id")
                    others = some["id"].to_numpy(np.int64)
                    sim = np.round(mine @ _unit(list(some["v"])).T, 9)
                    sim[ids[:, None] == others[None, :]] = -np.inf
                    best = sim.argmax(axis=1)
                    top = sim[np.arange(len(ids)), best]
                    ok = np.isfinite(top)
                    out.append(pd.DataFrame({"id": ids[ok], "nearest": others[best[ok]], "similarity": top[ok]}))
                if out:
                    yield pd.concat(out)

        one = rows.where("v IS NOT NULL AND id IS NOT NULL").select("id", "group", "v").mapInPandas(run, "id long, nearest long, similarity double")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("nearest")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("nearest"), "b.similarity")
