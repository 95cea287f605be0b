"""Rows that the order of a query's SQL leaves equal: they come in order of the table, as DuckDB mostly takes them."""

from __future__ import annotations

import duckdb
import pytest
from comparing import same_rows
from pyspark.sql import functions as F

from binsift.registry import ORACLE_SQL, QUERIES

NAMES = ["a19_dedup_keep_first", "s17b_html_rows"]


def test_rows_of_one_candidate_number_stay_in_order_of_the_table(spark, tmp_path):
    """Three rows of each number, the surest first: by their contents they would come the other way round."""
    lines = spark.range(60, numPartitions=1).select(
        (F.col("id") % 20).alias("l_orderkey"), F.lit(0).cast("long").alias("l_partkey"), F.lit(3).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.lit(50.0) - F.floor(F.col("id") / 20)).alias("l_quantity"), F.element_at(F.array(*map(F.lit, "RNA")), (F.floor(F.col("id") / 20) + 1).cast("int")).alias("l_returnflag"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rows = QUERIES["s17b_html_rows"](spark, str(tmp_path)).orderBy("line_no").limit(3).collect()
    assert ["<td>100</td>" in rows[0].html, "<td>98</td>" in rows[1].html, "<td>96</td>" in rows[2].html] == [True] * 3
    assert QUERIES["a19_dedup_keep_first"](spark, str(tmp_path)).first().conf_pct == 100
    # DuckDB's sort isn't stable where so many rows are equal, so only the grouped query's rows are sure to be its.
    same_rows(QUERIES["a19_dedup_keep_first"](spark, str(tmp_path)), duck, ORACLE_SQL["a19_dedup_keep_first"])


@pytest.mark.parametrize("name", NAMES)
def test_ties_of_the_given_table(spark, name):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])
