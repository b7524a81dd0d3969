"""Registry of named queries. Each has a Spark build and, where one exists, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shiftledger.catalog.views import with_views
from shiftledger.sources.mapping import Landing


@dataclass(frozen=True)
class Query:
    build: Callable[[Landing], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Landing(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None, needs: str = ""):
    """Register the decorated build under ``key``. ``needs`` names the views that ``sql`` reads."""

    def register(build: Callable[[Landing], DataFrame]) -> Callable[[Landing], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(build, with_views(needs, sql) if sql else None)
        return build

    return register


def same_as(other: str, key: str):
    """Register the decorated build under ``key``, with the SQL of a query registered before."""

    def register(build: Callable[[Landing], DataFrame]) -> Callable[[Landing], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(build, QUERIES[other].sql)
        return build

    return register
