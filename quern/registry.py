"""Queries by name with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _long_counts(sql: str) -> str:
    """count_if is a 128-bit integer in DuckDB; ours is a long."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], "CAST(", sql[start:end], " AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name; sql is DuckDB's for the same rows."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = _long_counts(sql)
        return f

    return put
