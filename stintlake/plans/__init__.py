"""All registered queries."""

from . import articles, charts, context, editorial, entities, facets, ingestion, lookups, news, payloads, provided, statistics, stories, timing, upkeep, world
from .registry import ORACLE_SQL, QUERIES

ORACLE_SQL["streaming_merge"] = """
SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events) WHERE n = 1"""
ORACLE_SQL["streaming_windows"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"

__all__ = ["ORACLE_SQL", "QUERIES", "articles", "charts", "context", "editorial", "entities", "facets", "ingestion", "lookups", "news", "payloads", "provided", "statistics", "stories", "timing", "upkeep", "world"]
