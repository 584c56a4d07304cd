"""Registered queries and, for those that SQL can express, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict, dict]:
    from . import cluster_queries, family_queries, label_queries, model_queries, review_queries, source_queries, text_queries  # noqa: F401

    return dict(QUERIES), dict(SQL)
