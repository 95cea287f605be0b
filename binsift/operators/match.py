"""Matching call sites against rules, and the scores that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import raw_address

#: Severity order of sinks when a function's worst one is named.
SINK_ORDER = ["command_injection", "buffer_overflow", "format_string", "uaf"]
# Points of a call, beside the rule's own, and what a kind of match leaves of them.
SINK, SINK_TYPE, UNBOUNDED, EXTERNAL, RETURNED = 10, {"command_injection": 5, "buffer_overflow": 4, "format_string": 3, "uaf": 2}, 5, 3, 2
KIND_WEIGHT = {"LIBRARY_MATCH": 1.0, "STRUCTURAL_MATCH": 0.8, "NO_MATCH": 0.5}


def calls(ops: DataFrame) -> DataFrame:
    """CALL operations with a callee: fn, seq, callee, args, sizes, returns (whether a result is used)."""
    return ops.filter("op = 'CALL' AND callee IS NOT NULL").select("fn", "seq", "callee", "args", "sizes", F.col("out_var").isNotNull().alias("returns"))


def library(call_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls with their rule's columns, null where no rule names the callee. The rule table is a small dimension."""
    return call_rows.join(rules, call_rows["callee"] == rules["rule_fn"], "left")


def structural_key(sizes: Column, returns: Column) -> Column:
    """Key of a structural rule: sorted argument sizes and whether a result is used."""
    return F.concat(F.array_join(F.array_sort(sizes).cast("array<string>"), ","), F.when(returns, "|1").otherwise("|0"))


def best_structural(rules: DataFrame) -> DataFrame:
    """One rule of each key: by confidence, then hits, then name."""
    order = Window.partitionBy("skey").orderBy(F.desc("confidence"), F.desc("hit_count"), "rule_fn")
    return rules.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def cascade(call_rows: DataFrame, library_rules: DataFrame, structural_rules: DataFrame, learned_rules: DataFrame) -> DataFrame:
    """Each call's first match of three tiers: library by name, structural by argument sizes (addresses only), learned
    by name (of roles that carry effects): fn, seq, callee, match_kind, confidence, vuln_score, returns.

    A structural match whose rule disagrees on the use of a result keeps 0.6 of its confidence, at least 0.3. NO_MATCH
    has confidence and score 0.
    """
    lib = library_rules.select("rule_fn", F.col("confidence").alias("lib_conf"), F.col("vuln_score").alias("lib_score"))
    struct = best_structural(structural_rules).select("skey", F.col("confidence").alias("str_conf"), F.col("vuln_score").alias("str_score"), F.col("ret_exists").alias("str_ret"))
    learn = learned_rules.filter(F.col("role").isin("allocator", "copy", "read_input", "exec", "validator")).select(F.col("rule_fn").alias("learn_fn"), F.col("confidence").alias("learn_conf"), F.col("vuln_score").alias("learn_score"))
    keyed = call_rows.withColumn("skey", F.when(raw_address(F.col("callee")), structural_key(F.col("sizes"), F.col("returns"))))
    hit = keyed.join(lib, keyed["callee"] == lib["rule_fn"], "left").join(struct, "skey", "left").join(learn, keyed["callee"] == learn["learn_fn"], "left")
    adjusted = F.when(F.col("str_ret") != F.col("returns"), F.greatest(F.lit(0.3), F.col("str_conf") * 0.6)).otherwise(F.col("str_conf"))
    kind = F.when(F.col("lib_conf").isNotNull(), "LIBRARY_MATCH").when(F.col("str_conf").isNotNull(), "STRUCTURAL_MATCH").when(F.col("learn_conf").isNotNull(), "LEARNED_MATCH").otherwise("NO_MATCH")
    return hit.select("fn", "seq", "callee", kind.alias("match_kind"), F.coalesce("lib_conf", adjusted, "learn_conf", F.lit(0.0)).alias("confidence"), F.coalesce("lib_score", "str_score", "learn_score", F.lit(0.0)).alias("vuln_score"), "returns")


def external_source() -> Column:
    """Whether a matched call brings external data in."""
    return (F.size("external_input") > 0) | F.col("writes_all_ptr")


def call_score(kind: Column | None = None) -> Column:
    """Points of one matched call, to two places; 0 without a rule."""
    writes = (F.col("writes_at") >= 0) | F.col("writes_all_ptr")
    bonus = F.lit(0)
    for name, points in SINK_TYPE.items():
        bonus = F.when(F.col("sink_type") == name, points).otherwise(bonus)
    as_sink = F.when(F.col("sink"), F.lit(SINK) + bonus + F.when(~F.col("bounded") & writes, UNBOUNDED).otherwise(0)).otherwise(0)
    points = F.col("vuln_score") + as_sink + F.when(external_source(), EXTERNAL).otherwise(0) + F.when(F.col("return_tainted"), RETURNED).otherwise(0)
    weight = F.lit(1.0)
    if kind is not None:
        for name, w in KIND_WEIGHT.items():
            weight = F.when(kind == name, w).otherwise(weight)
    return F.when(F.col("rule_fn").isNull(), F.lit(0.0)).otherwise(F.round(points * F.col("confidence") * weight, 2))


def function_risk(matched: DataFrame) -> DataFrame:
    """Summed call score of each function, its numbers of sinks and sources, and its worst sink type."""
    order = F.lit(len(SINK_ORDER))
    for i in reversed(range(len(SINK_ORDER))):
        order = F.when(F.col("sink_type") == SINK_ORDER[i], i).otherwise(order)
    matched = matched.filter("rule_fn IS NOT NULL")
    scored = matched.withColumn("_score", call_score()).withColumn("_order", order)
    return scored.groupBy("fn").agg(
        F.round(F.sum("_score"), 2).alias("score"),
        F.count_if("sink").alias("sinks"),
        F.count_if(external_source()).alias("sources"),
        F.coalesce(F.min_by(F.col("sink_type"), F.when(F.col("sink") & (F.col("_order") < len(SINK_ORDER)), F.col("_order"))), F.lit("")).alias("top_sink"),
    )


def top_functions(risk: DataFrame, n: int) -> DataFrame:
    return risk.orderBy(F.desc("score"), "fn").limit(n)


def unknown_calls(call_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls that no library rule names."""
    return call_rows.join(rules, call_rows["callee"] == rules["rule_fn"], "left_anti")


def internal_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges whose callee is a known function."""
    return edges.join(functions.select(F.col("fn").alias("callee")), "callee", "left_semi")


def effects(matched: DataFrame) -> DataFrame:
    """What a matched call does to its operands: external (taints result), the arguments it taints, the variable whose
    memory it writes, the variable read, the size variables that exist."""
    arg = lambda i: F.get("args", i)
    pick = lambda ix: F.filter(F.transform(ix, lambda i: F.get("args", i)), lambda v: v.isNotNull())
    pointers = F.transform(F.filter(F.arrays_zip("args", "sizes"), lambda x: x["sizes"] == 8), lambda x: x["args"])
    return matched.select(
        "fn",
        "seq",
        "callee",
        external_source().alias("is_external_source"),
        pick(F.col("external_input")).alias("tainted_args"),
        F.when(F.col("writes_all_ptr"), pointers).when(F.col("writes_at") >= 0, F.filter(F.array(arg(F.col("writes_at"))), lambda v: v.isNotNull())).otherwise(F.array().cast("array<string>")).alias("written"),
        F.when(F.col("reads_from") >= 0, arg(F.col("reads_from"))).alias("source_var"),
        pick(F.col("size_args")).alias("size_vars"),
    )


def argument_effects(call_rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Arguments of calls with the effects that summaries (callee, arg_idx, effect) give them."""
    args = call_rows.select("fn", "seq", "callee", F.posexplode("args").alias("arg_idx", "var"))
    return args.join(summaries, ["callee", "arg_idx"])
