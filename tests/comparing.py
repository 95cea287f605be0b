"""Spark against DuckDB on the same tables."""

from __future__ import annotations

from typing import Any

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value: Any) -> Any:
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def same_rows(df: DataFrame, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    theirs = sorted(repr([plain(r[names.index(k)]) for k in order]) for r in got.fetchall())
    ours = sorted(repr([plain(v) for v in r]) for r in df.select(*order).collect())
    assert ours == theirs
