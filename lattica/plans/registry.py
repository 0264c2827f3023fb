"""All queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a function of Tables under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(views, sql)
        return f

    return add


def load() -> tuple[dict, dict]:
    from lattica.plans import files, graphs, records, sources  # noqa: F401  (they register their queries)

    return QUERIES, SQL
