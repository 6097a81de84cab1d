"""Named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skytally.plans import carriers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """Attribute access to the views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return carriers.frame(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(Views) -> DataFrame``. ``sql`` continues the WITH list of ``views``: it starts with a
    comma to add steps, or with SELECT."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            head = carriers.ctes(*views.split()) if views else ""
            ORACLE[name] = f"{head}{body}" if body.startswith(",") else f"{head}\n{body}".strip()
        return fn

    return register


def r(expr: str, places: int = 6) -> str:
    """Report rounding in checking SQL."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"
