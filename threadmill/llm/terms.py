"""How often every term occurs, and which terms are too rare or too common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SQL = r"""
WITH seen AS (
  SELECT lower(regexp_replace(term, r'^[\s\pZ]+|[\s\pZ]+$', '')) AS term, exchange_id, term AS spelled, tech, off
  FROM {t} WHERE coalesce(tech, 0) <> 0 OR coalesce(off, 0) <> 0
),
records AS (
  SELECT term, exchange_id, spelled, coalesce(tech, 0) AS tech, coalesce(off, 0) AS off FROM seen
  WHERE term IS NOT NULL AND term <> '' GROUP BY ALL
),
per_record AS (SELECT term, exchange_id, sum(tech) AS tech, sum(off) AS off FROM records GROUP BY term, exchange_id),
totals AS (SELECT term, sum(tech) AS tech, sum(off) AS off, count(exchange_id) AS n_exchanges FROM per_record GROUP BY term)
SELECT term, tech, off, n_exchanges,
       CASE WHEN n_exchanges < {rare} THEN 'rare'
            WHEN n_exchanges * 10000 > {common} * (SELECT count(DISTINCT exchange_id) FROM {t}) THEN 'common' END AS band
FROM totals
"""


def term_totals(mined: DataFrame, rare_below: int = 3, common_above: float = 0.08) -> DataFrame:
    """Totals of every term: term, tech, off, n_exchanges, band (rare, common or null).

    Terms are compared in lower case without blanks at the ends.  Null and
    blank terms and rows whose counts are null or zero on both sides are left
    out; a row that is repeated exactly counts once; different spellings in one
    exchange add up.  n_exchanges counts distinct exchanges (a null exchange_id
    adds to the totals only).  ``common_above`` is a share of all distinct
    exchange ids of the table.  Every step combines map-side before its
    shuffle, so a term in a third of all rows is one partial row per task.  An
    empty table gives no row.
    """
    return mined.sparkSession.sql(_SQL.format(t="{t}", rare=int(rare_below), common=round(common_above * 10000)), t=mined)


def marked_terms(mined: DataFrame, rare_below: int = 3, common_above: float = 0.08) -> DataFrame:
    """The terms that are too rare or too common: term, band."""
    return term_totals(mined, rare_below, common_above).where(F.col("band").isNotNull()).select("term", "band")
