"""Statistics and hashes as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def hash_byte(key: Column) -> Column:
    """First byte of the SHA-256 of a key's decimal form."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int")


def in_holdout(key: Column) -> Column:
    return F.pmod(hash_byte(key), F.lit(5)) == 0


def fold(key: Column, folds: int = 5) -> Column:
    return F.pmod(hash_byte(key), F.lit(folds)).cast("int")


def hash_order(seed: str, key: Column) -> Column:
    """A reproducible random order: sort by this."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def wilson(good: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; null without observations."""
    z2 = Z95 * Z95
    n = F.when(total > 0, total)
    p = good / n
    centre = p + z2 / (2 * n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return (centre - half) / scale, (centre + half) / scale


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def chi2_survival(half_x: Column, half_df: Column) -> Column:
    """Survival of chi-square with even degrees: exp(-h) * sum of h^i/i!, i below half_df; at most 1."""
    start = F.struct(F.exp(-half_x).alias("term"), F.exp(-half_x).alias("total"))
    step = lambda acc, i: F.struct((acc.term * half_x / i).alias("term"), (acc.total + acc.term * half_x / i).alias("total"))
    every = F.when(half_df > 1, F.sequence(F.lit(1), (half_df - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(every, start, step, lambda acc: acc.total))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def bucket(n: Column, bounds: list[tuple[int, str]], rest: str) -> Column:
    """The label of the first upper bound that n doesn't exceed."""
    out = None
    for limit, label in bounds:
        out = F.when(n <= limit, label) if out is None else out.when(n <= limit, label)
    return out.otherwise(rest)
