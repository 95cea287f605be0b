"""Every query of the engine by name, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import on_findings, on_graph, on_more, on_ops, on_rest, on_rules, on_taint  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions ranked by the summed score of their rule matches."""
    return QUERIES["t02_top_functions"](spark, sf_dir)
