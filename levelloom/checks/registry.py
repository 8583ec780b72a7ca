"""Registered queries: a Spark run over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from levelloom.plans.views import VIEWS, with_views
from levelloom.session import tune


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Views:
    """Lazy access to the views: ``v.notes`` builds that view's DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        found = VIEWS[name][0](self.spark, self.sf_dir) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = found  # a view that writes a table writes it once
        return found


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(views) -> DataFrame``; ``extra`` adds CTEs shared by several oracles."""

    def register(fn):
        full = with_views(sql, extra) if sql else None
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Views(tune(spark), sf_dir)), full)
        return fn

    return register
