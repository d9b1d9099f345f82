"""Where query modules register a query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def any_sql(column: str, patterns: list[str]) -> str:
    """SQL for text.any_of()."""
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches(coalesce({column}, ''), '(?i){joined}')"


def contains_sql(column: str, words: list[str]) -> str:
    """SQL for text.contains_any()."""
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def list_sql(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"
