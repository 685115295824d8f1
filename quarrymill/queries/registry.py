"""A registry of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder by attribute: t.violations."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    def once(self, name: str, key: str, *columns: str) -> DataFrame:
        """The named columns of a table whose rows may come twice, identical: each key once. Nothing else is read."""
        return getattr(self, name).select(key, *columns).distinct()


def collection() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """QUERIES, SQL, and a decorator that registers a function of Tables under its name, with its SQL if there is one."""
    queries: dict[str, Query] = {}
    statements: dict[str, str] = {}

    def register(sql: str | None = None):
        def keep(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, sf: f(Tables(spark, sf))
            if sql:
                statements[f.__name__] = sql
            return f

        return keep

    return queries, statements, register
