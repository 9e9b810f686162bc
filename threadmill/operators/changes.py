"""Rebuilding a table from a feed of inserts, updates and deletes.  SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: One aggregation, combined map-side, so neither repeated deliveries nor a key
#: with a large share of the feed need a sort or a window.
_SQL = """
WITH folded AS (
  SELECT message_id,
         max(CASE WHEN op IN ('insert', 'update') THEN struct(coalesce(revision, -1) AS r, change_seq AS s) END) AS winner,
         max_by(revision, struct(coalesce(revision, -1), change_seq)) FILTER (WHERE op IN ('insert', 'update')) AS revision,
         max_by(coalesce(edited_at, created_at), struct(coalesce(revision, -1), change_seq)) FILTER (WHERE op IN ('insert', 'update')) AS written_at,
         max(deleted_at) FILTER (WHERE op = 'delete') AS last_delete
         {fields}
  FROM {feed} WHERE message_id IS NOT NULL
  GROUP BY message_id
)
SELECT message_id, revision, winner.s AS change_seq {kept}
FROM folded
WHERE winner IS NOT NULL AND (last_delete IS NULL OR written_at IS NULL OR NOT last_delete > written_at)
"""


def apply_changes(feed: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """The living messages of a change feed, each with its winning change.

    Of a message's inserts and updates the highest revision wins (null lowest),
    among equal ones the highest change_seq; rows with one change_seq are one
    change.  A message is alive unless a delete is later than the winner's
    edited_at (created_at if null; alive if both are null).  Each of ``fields``
    is taken by itself: from the highest change that sets it (isn't null) and
    isn't outdated by the latest delete, else null.  Rows without a message_id
    and with other ops are ignored; a message with deletes only gives no row;
    an empty feed gives none.
    """
    order = "struct(coalesce(revision, -1), change_seq)"
    each = "".join(
        f", max_by(struct({f} AS v, coalesce(edited_at, created_at) AS at), {order})"
        f" FILTER (WHERE op IN ('insert', 'update') AND {f} IS NOT NULL) AS w_{f}"
        for f in fields
    )
    kept = "".join(f", CASE WHEN last_delete IS NULL OR NOT coalesce(last_delete > w_{f}.at, false) THEN w_{f}.v END AS {f}" for f in fields)
    return feed.sparkSession.sql(_SQL.format(fields=each, kept=kept, feed="{feed}"), feed=feed)
