"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


for _part in ("company_queries", "segment_queries", "region_queries", "layout_queries", "trend_queries", "series_queries", "panel_queries", "annotation_queries", "find_queries", "quality_queries", "guarded_queries", "text_queries", "quote_queries", "transcript_queries", "usage_queries"):
    import_module(f"quillstone.plans.{_part}")
