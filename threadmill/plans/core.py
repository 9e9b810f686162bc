"""All queries of the core; importing this registers them."""

from __future__ import annotations

from . import claims_queries, classify_queries, grouping_queries, label_queries, lexicon_queries, publish_queries, relational_queries, stream_queries, text_queries  # noqa: F401
from .registry import CORE as core  # noqa: F401
