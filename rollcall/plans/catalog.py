"""Registration: a query in Spark beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.views import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def whole_counts(sql: str) -> str:
    """``count_if(x)``, a 128-bit number in DuckDB, as a plain count with Spark's 64 bits."""
    start = sql.find("count_if(")
    while start >= 0:
        at, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[:start]}count(CASE WHEN {sql[start + len('count_if('):at - 1]} THEN 1 END){sql[at:]}"
        start = sql.find("count_if(")
    return sql


def query(sql: str | None = None, name: str | None = None, ctes: str = ""):
    """Register a function (spark, directory) under its name; ``sql`` may use the views and ``ctes``."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = whole_counts(f"WITH RECURSIVE {SQL}{', ' + ctes if ctes else ''}\n{sql}")
        return f

    return register
