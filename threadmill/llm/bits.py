"""A bitmap of terms' hashes: a filter of fixed size that terms pass before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (a power of two, 4 MB); hashes are CRC32 of the UTF-8 form.
FILTER_BITS = 1 << 25


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of ``terms`` (term); others may pass it, a join decides."""
    place = F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1  # buckets count from 1
    found = terms.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in found.toLocalIterator():
        at = (r["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits
