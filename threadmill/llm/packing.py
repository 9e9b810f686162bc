"""Filling fixed-capacity containers with items of varying length.

Dynamic programming over the global histogram of lengths chooses bucket
boundaries that minimise padding (the histogram has at most ``capacity``
entries, whatever the number of items).  Each bucket's items take slots of the
bucket's boundary; batches form inside a bucket under the token budget.  What
room a batch leaves may also be given to slots of smaller buckets (``mixed``),
all worked out on bucket counts.  Items find their slot by their rank in their bucket, which
is counted in salted parts, so no bucket is ever one task's.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .tokens import TOKENIZER, token_counts


def boundaries(histogram: Mapping[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    count = np.array([histogram[int(x)] for x in lengths], np.float64)
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * lengths)])
    d, m = len(lengths), min(buckets, len(lengths))
    # cost[i, j]: padding of lengths i..j-1 in a bucket bounded by lengths[j-1]
    cost = np.full((d + 1, d + 1), np.inf)
    for j in range(1, d + 1):
        cost[:j, j] = lengths[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
    best = np.full(d + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(m):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    cuts, j = [], d
    for step in reversed(back):
        if j == 0:
            break
        cuts.append(int(lengths[j - 1]))
        j = int(step[j])
    return cuts[::-1]


def patterns(counts: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Container patterns (slots per boundary) with how often each is used.

    Every pattern takes as many slots of the largest bucket left as fit, then
    fills its room with the next smaller ones; it is used until one of its
    buckets runs out.
    """
    left = {b: n for b, n in counts.items() if n}
    out = []
    while left:
        room, slots = capacity, {}
        for b in sorted(left, reverse=True):
            k = min(room // b, left[b])
            if k:
                slots[b] = int(k)
                room -= k * b
        times = min(left[b] // k for b, k in slots.items())
        for b, k in slots.items():
            left[b] -= k * times
            if not left[b]:
                del left[b]
        out.append((slots, int(times)))
    return out


def batches(counts: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Container patterns of one bucket each: as many slots as the capacity holds, and one batch of the rest."""
    out = []
    for b, n in sorted(counts.items(), reverse=True):
        full, rest = divmod(n, capacity // b)
        out += [({b: capacity // b}, full)] * bool(full) + [({b: rest}, 1)] * bool(rest)
    return out


def segments(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(boundary, from rank, to rank, first container, slots per container, start of the first slot)."""
    rank: dict[int, int] = {}
    out, container = [], 0
    for slots, times in found:
        at = 0
        for b in sorted(slots, reverse=True):
            f = rank.get(b, 0)
            rank[b] = f + slots[b] * times
            out.append((b, f, rank[b], container, slots[b], at))
            at += slots[b] * b
        container += times
    return out


def pack(items: DataFrame, capacity: int = 2048, buckets: int = 96, part_rows: int = 50_000, mixed: bool = True) -> DataFrame:
    """Container of every item: id, piece, n_tokens, bucket, container_id, start.

    ``items`` has id and n_tokens.  An item longer than ``capacity`` is split
    into full pieces and a rest; no other is split.  ``bucket`` is the bucket's
    upper bound, ``start`` the slot's first place in its container.  Items of
    no length get no container (nulls).  Repeated ids are items of their own.
    An empty table gives no row.  ``mixed``: whether room that a batch leaves is
    given to slots of smaller buckets.
    """
    spark = items.sparkSession
    cap = F.lit(capacity)
    n = F.coalesce("n_tokens", F.lit(0))
    pieces = items.select("id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / cap).cast("int") - 1))).alias("piece"))
    pieces = pieces.select("id", "piece", F.least(F.col("n") - F.col("piece") * cap, cap).cast("int").alias("n_tokens"))
    pieces = settle(pieces, "pieces")
    histogram = {r["n_tokens"]: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    bounds = boundaries(histogram, buckets)
    bucket_of, at = {}, 0
    for length in sorted(histogram):
        while bounds[at] < length:
            at += 1
        bucket_of[length] = bounds[at]
    counts: dict[int, int] = {}
    for length, k in histogram.items():
        counts[bucket_of[length]] = counts.get(bucket_of[length], 0) + k
    lookup = spark.createDataFrame(sorted(bucket_of.items()), "n_tokens int, bucket int")
    plan = spark.createDataFrame(segments((patterns if mixed else batches)(counts, capacity)), "bucket int, lo long, hi long, first long, per long, base long")
    salts = max(1, -(-sum(histogram.values()) // part_rows))
    # At most one row per length (lookup, plan: bounded by the capacity), so both may be broadcast.
    rows = pieces.where("n_tokens > 0").join(F.broadcast(lookup), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    sizes = rows.groupBy("bucket", "salt").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", "salt", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("id", "piece", "n_tokens")) - 1
    ranked = rows.withColumn("inner", inner).join(offsets, ["bucket", "salt"]).withColumn("rank", F.col("before") + F.col("inner"))
    p, r = F.broadcast(plan).alias("p"), ranked.alias("r")
    placed = r.join(p, (F.col("r.bucket") == F.col("p.bucket")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    out = placed.select(
        "id", "piece", "n_tokens", F.col("r.bucket").alias("bucket"), (F.col("first") + F.floor(k / F.col("per"))).cast("long").alias("container_id"),
        (F.col("base") + F.pmod(k, F.col("per")) * F.col("r.bucket")).cast("int").alias("start"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    none = pieces.where("n_tokens <= 0").select("id", "piece", "n_tokens", null("int").alias("bucket"), null("long").alias("container_id"), null("int").alias("start"))
    return out.unionByName(none)


def pack_documents(documents: DataFrame, capacity: int = 2048, buckets: int = 96, path: str = TOKENIZER, mixed: bool = True) -> DataFrame:
    """``pack`` over the token counts of documents (doc_id, text)."""
    return pack(token_counts(documents, path=path), capacity, buckets, mixed=mixed).withColumnRenamed("id", "doc_id")
