"""How a module lists its queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.folders import shared_dir


class Book:
    """Queries by name, each with its SQL if there is one."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def listed(f):
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.oracles[name or f.__name__] = sql
            return f

        return listed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"
