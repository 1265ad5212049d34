"""The registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the DuckDB SQL that gives the same rows."""

    def register(function):
        QUERIES[name or function.__name__] = function
        if sql:
            SQL[name or function.__name__] = sql
        return function

    return register


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from . import corpus_queries, judgment_queries, layout_queries, span_queries, text_queries  # noqa: F401

    return QUERIES, SQL
