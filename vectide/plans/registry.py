"""Registry of runnable queries and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.plans.oracle_views import VIEWS
from vectide.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def with_views(body: str) -> str:
    """`body` behind the views it names, directly or through other views."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    own = re.match(r"\s*WITH\b", body)
    return f"WITH RECURSIVE {ctes}{',' if own else ''}\n{body[own.end():] if own else body}"


def query(name: str, sql: str | None = None, queries: dict[str, Query] = QUERIES, oracle: dict[str, str] = ORACLE):
    """Registers fn(spark, folder) under `name`; the session gets the UTC and AQE settings first."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(apply_settings(spark), folder)

        if name in queries:
            raise ValueError(f"query {name} is registered twice")
        queries[name] = run
        if sql is not None:
            oracle[name] = with_views(sql)
        return run

    return register
