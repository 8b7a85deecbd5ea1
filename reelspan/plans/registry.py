"""All registered queries and their SQL by name."""

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, build, sql: str | None = None) -> None:
    """Register build(spark, sf_dir) and, where SQL can say the same, its text for DuckDB."""
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def load() -> None:
    for part in ("scoring_queries", "caption_queries", "vector_queries", "pixel_queries", "release_queries", "usage_queries"):
        importlib.import_module(f"reelspan.plans.{part}")
