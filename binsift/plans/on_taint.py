"""Queries over the forward taint walk, what functions do to each other, and the composed stages. The walk is held against
the same state machine in SQL; what follows calls from function to function is held against brute force in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import ops, pipeline, report, taint
from . import taint_sql
from .base import Source, query


def _ops(s: Source) -> DataFrame:
    return ops.of_bridge(s.b_ops)


def _walked(s: Source) -> DataFrame:
    return taint.analyze(ops.of_programs(s.b_prog), whole=True)


@query("x26_forward_taint", taint_sql.CANDIDATES)
def x26(s: Source) -> DataFrame:
    return taint.candidates(_walked(s)).select(*taint.CANDIDATE)


@query("x04_flow_steps", taint_sql.STEPS)
def x04(s: Source) -> DataFrame:
    return taint.flow_steps(_walked(s))


@query("x05_tainted_variables", taint_sql.TAINTED)
def x05(s: Source) -> DataFrame:
    return taint.tainted(_walked(s))


@query("x17_variable_marks", taint_sql.MARKS)
def x17(s: Source) -> DataFrame:
    return taint.marks(_walked(s))


@query("x13_unknown_calls", taint_sql.UNKNOWN)
def x13(s: Source) -> DataFrame:
    return _walked(s).select("fn", "unknown_calls")


@query("g11_function_summaries")
def g11(s: Source) -> DataFrame:
    flat = ops.of_programs(s.b_prog)
    return taint.summaries(flat, whole=True).select("fn", F.col("arg").alias("arg_idx"), "effect")


@query("g11b_own_summaries", taint_sql.OWN_EFFECTS)
def g11b(s: Source) -> DataFrame:
    flat = ops.of_programs(s.b_prog)
    return taint.summaries(flat, chained=False, whole=True).filter("effect NOT LIKE 'field:%'")


@query("g14_external_arguments", taint_sql.ENTERED)
def g14(s: Source) -> DataFrame:
    return taint.external_arguments(ops.of_programs(s.b_prog), whole=True)


@query("x03_taint_from_callers", taint_sql.FROM_CALLERS)
def x03(s: Source) -> DataFrame:
    flat = ops.of_programs(s.b_prog)
    return taint.candidates(taint.analyze(flat, external=taint.external_arguments(flat, whole=True), whole=True)).select(*taint.CANDIDATE)


@query("x11_taint_through_calls")
def x11(s: Source) -> DataFrame:
    flat = ops.of_programs(s.b_prog)
    effects = taint.summaries(flat, whole=True, met=True)
    return taint.candidates(taint.analyze(flat, effects, taint.external_arguments(flat, effects, whole=True), whole=True)).select(*taint.CANDIDATE)


@query("r11_ranked_functions")
def r11(s: Source) -> DataFrame:
    return pipeline.ranked(_ops(s), s.b_edges, dims.rules(s.spark)).drop("category")


@query("r11b_selected_functions")
def r11b(s: Source) -> DataFrame:
    rows = pipeline.ranked(_ops(s), s.b_edges, dims.rules(s.spark))
    return pipeline.selected(rows, 40, {"parser": 0.3, "memory": 0.2}).select("fn", "category", "final", "filled")


@query("e06_evidence_vectors")
def e06(s: Source) -> DataFrame:
    return pipeline.evidence_vectors(ops.of_programs(s.b_prog)).drop("cand_id")


@query("e09_findings_without_models")
def e09(s: Source) -> DataFrame:
    return pipeline.without_models(ops.of_programs(s.b_prog)).drop("cand_id")


@query("s17_html_report")
def s17(s: Source) -> DataFrame:
    found = pipeline.without_models(ops.of_programs(s.b_prog)).withColumn("conf_pct", F.round(F.col("confidence") * 100).cast("int"))
    return report.html_report(found.filter("confirmed"), found.filter("NOT confirmed"), "program", "fn", "vuln_type", "sink_fn")
