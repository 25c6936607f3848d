"""Name -> (Spark query, reference SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.views import Tables
from tessera.plans.views_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables)``; ``views`` names the derived views the SQL text starts from."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        assert name not in QUERIES, name
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(views.split(), sql)
        return fn

    return wrap
