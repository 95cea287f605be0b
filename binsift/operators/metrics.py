"""Accuracy, cost and distribution metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, places: int = 3) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), places)


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted", by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined), of all rows or of each group."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    g = rows.groupBy(by) if by else rows
    c = g.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cost_by_stage(calls: DataFrame, price: float) -> DataFrame:
    """Calls, tokens and cost of each stage and of all together (stage TOTAL)."""
    r = calls.rollup("stage").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.grouping("stage").alias("_all"))
    return r.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("stage")).alias("stage"), "calls", "tokens", F.round(F.col("tokens") / 1000.0 * price, 6).alias("cost"))


def score_bins(rows: DataFrame, pct: str = "conf_pct") -> DataFrame:
    """Rows in five equal bins of a percentage."""
    b = F.least(F.floor(F.col(pct) / 20), F.lit(4)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def routing_metrics(fused: DataFrame) -> DataFrame:
    """Counts by route, the share sent to consensus and the share saved."""
    c = fused.agg(F.count("*").alias("n"), F.count_if(F.col("routing") == "needs_consensus").alias("consensus"), F.count_if(F.col("routing") == "bayes_direct_confirm").alias("direct_confirm"), F.count_if(F.col("routing") == "bayes_direct_reject").alias("direct_reject"))
    return c.select("*", _ratio(F.col("consensus"), F.col("n"), 4).alias("consensus_rate"), _ratio((F.col("n") - F.col("consensus")) * 100, F.col("n"), 2).alias("saved_pct"))


def reduction(before: Column, after: Column) -> Column:
    """Percent less, one place; 0 of nothing."""
    return _ratio((before - after) * 100, before, 1)


def outcomes(rows: DataFrame, status: str) -> DataFrame:
    """Count and percent of each status."""
    from pyspark.sql import Window

    n = rows.groupBy(status).agg(F.count("*").alias("n"))
    return n.select(status, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 2).alias("pct"))


def confusion_with_total(rows: DataFrame, by: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """confusion of each group and, as group TOTAL, of all rows together."""
    return confusion(rows, label, predicted, by).unionByName(confusion(rows, label, predicted).withColumn(by, F.lit("TOTAL")))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))


def stored_stats(rows: DataFrame, key: str, role: str) -> DataFrame:
    """Rows and distinct keys of a stored table by role and in all (role TOTAL)."""
    r = rows.rollup(role).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.grouping(role).alias("_all"))
    return r.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(role)).alias("role"), "n", "keys")


def write_results(rows: DataFrame, path: str) -> None:
    """Results as JSON lines and as CSV with a header, in folders of their own under path."""
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_costs(calls: DataFrame, price: float, path: str) -> None:
    """Cost log: a summary by stage with TOTAL, and the records, as JSON in folders of their own under path."""
    cost_by_stage(calls, price).write.mode("overwrite").json(f"{path}/summary")
    calls.write.mode("overwrite").json(f"{path}/records")
