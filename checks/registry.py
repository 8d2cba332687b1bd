"""Where queries register themselves together with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the tables that the SQL names, directly or not, in front of it."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()
    open_sql = [body]
    while open_sql:
        words = set(re.findall(r"[a-z_]+", open_sql.pop()))
        for name in words & known.keys() - needed:
            needed.add(name)
            open_sql.append(known[name])
    tables = ", ".join(f"{name} AS ({known[name]})" for name in known if name in needed)
    return f"WITH {tables} {body}" if tables else body


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_ctes(sql, ctes)
        return function

    return add
