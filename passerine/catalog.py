"""All analytics queries by name, and their SQL."""

from __future__ import annotations

from .plans import cluster_queries, event_queries, experiment_queries, frame_queries, stream_queries, vector_queries  # noqa: F401  (they register their queries)
from .plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
