"""Registration of queries: a name, what makes the DataFrame, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Source:
    """The tables and bridge views of a directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def placed(self, name: str) -> DataFrame:
        """A bridge view with the place of its rows in the table, by which DuckDB mostly takes rows that an order leaves equal."""
        return view(self.spark, self.dir, name, placed=True)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name) if name.startswith("b_") else self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Callable[[Source], DataFrame]]:
    """Register a function of Source under a name, with its SQL over bridge views."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add
