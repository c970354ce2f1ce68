"""The list of runnable queries, each with the inventory items it covers and its checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meterstone.plans.oracle_views import with_views
from meterstone.sources.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Views(spark, folder))

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(self.sql)


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a query under its function name. ``covers`` lists inventory items."""

    def add(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        key = name or build.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, tuple(covers.split()), build, sql)
        return build

    return add
