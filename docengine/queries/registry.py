"""Collects the queries of a module and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docengine.plans.staging import read_table, stage

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one directory, by attribute: t.pages, t.chunks, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query uses in several places, made and written once."""
        if name not in self.__dict__:
            self.__dict__[name] = stage(build())
        return self.__dict__[name]

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(build: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql:
                self.sql[build.__name__] = sql
            return build

        return add
