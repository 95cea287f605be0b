"""Composed stages: ranking of functions, evidence of candidates, and the run without language models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.names import contains_any
from . import evidence, fuse, graph, match, ops, select, sources, taint

def ranked(functions_ops: DataFrame, edges: DataFrame, rules: DataFrame, prototypes: DataFrame | None = None) -> DataFrame:
    """fn, the eight scores, total, role, category and the total after propagation over the call graph."""
    flat, edges = graph.saved(functions_ops), graph.saved(edges)
    f = graph.saved(ops.features(flat))
    role = ops.counter_role(f).select("fn", F.col("role").alias("by_count"), F.col("role_conf").alias("conf_by_count"))
    name = F.lower("fn")
    roles = role.select("fn", F.coalesce(select.role_by_name(name), "by_count").alias("role"), F.coalesce(select.role_confidence(name), "conf_by_count").alias("role_conf"))
    is_source = contains_any(F.lower("node"), [s.lower() for s in dims.TAINT_SOURCES])
    dist = graph.source_distance(edges, is_source).withColumnRenamed("node", "fn")
    reach = graph.reachable(edges, is_source, contains_any(F.lower("node"), ["write", "encode", "emit"])).select(F.col("node").alias("fn"), F.lit(True).alias("reachable"))
    seeds = graph.nodes(edges).filter(is_source)
    n = seeds.count()
    ppr = graph.page_rank(edges, seeds.withColumn("weight", F.lit(1.0 / n)) if n else None).select(F.col("node").alias("fn"), F.col("rank").alias("ppr"))
    dangerous = contains_any(F.lower("node"), [s.lower() for s in (*dims.TAINT_SOURCES, *dims.TAINT_SINKS)])
    reaches = graph.reaches_within(edges, dangerous, 3).select(F.col("node").alias("fn"), F.lit(True).alias("dangerous"))
    degree = graph.degrees(edges).select(F.col("node").alias("fn"), "fan_out")
    points = match.function_risk(match.library(match.calls(flat), rules)).select("fn", F.col("score").alias("call_points"))
    wide = f.join(graph.grows(ops.unchecked_stores(flat)), "fn")
    for extra in (roles, dist, reach, ppr, reaches, degree, points):
        wide = wide.join(graph.grows(extra), "fn", "left")
    if prototypes is not None:
        wide = wide.join(graph.grows(prototypes), "fn", "left")
    false, zero = F.lit(False), F.lit(0)
    full = wide.select(
        *[c for c in f.columns if c not in ("input_calls", "sink_calls")],
        F.size("input_calls").alias("n_input_calls"),
        F.size("sink_calls").alias("n_sink_calls"),
        "unchecked",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("role_conf", F.lit(0.0)).alias("role_conf"),
        F.coalesce("dist", F.lit(5)).alias("dist"),
        F.coalesce("reachable", false).alias("reachable"),
        F.coalesce("ppr", F.lit(0.0)).alias("ppr"),
        F.coalesce("dangerous", false).alias("dangerous"),
        F.coalesce("fan_out", zero).alias("fan_out"),
        F.coalesce("call_points", F.lit(0.0)).alias("call_points"),
        (F.col("prototype") if prototypes is not None else F.lit("")).alias("prototype"),
        false.alias("learned"),
        false.alias("stack_alloc"),
        (F.size("sink_calls") > 0).alias("sink_site"),
        (F.size("input_calls") > 0).alias("source_site"),
        ((F.size("sink_calls") > 0) | (F.size("input_calls") > 0)).alias("dangerous_callee"),
    )
    full = graph.saved(full)
    scored = evidence.scores(full)
    category = F.when((F.col("arithmetic") >= 0.60) & (F.col("arithmetic") >= F.col("exposure")), "arithmetic").otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in dims.ROLE_CATEGORY.items() for x in kv])[F.col("role")], F.lit("unknown")))
    labelled = graph.saved(scored.join(graph.grows(full.select("fn", "role", "instructions")), "fn").withColumn("category", category))
    spread = graph.propagate_scores(labelled.select(F.col("fn").alias("node"), F.col("total").alias("score"), F.col("instructions").alias("ops")), edges)
    return labelled.join(graph.grows(spread.select(F.col("node").alias("fn"), F.col("score").alias("final"))), "fn").drop("instructions")


def selected(rows: DataFrame, budget: int, profile: dict[str, float]) -> DataFrame:
    """The functions to look at: three quarters of the budget by category quota, the rest by score."""
    return select.by_quota(rows, select.adaptive_quotas(profile, int(budget * 0.75)), budget, "final", "fn")


def semantic(flat: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Semantic risk candidates of functions, with their roles where known: fn, vuln_type, items."""
    arith = flat.groupBy("fn").agg(F.count_if(F.col("op").isin("INT_ADD", "INT_MULT")).alias("arith"))
    counters = ops.risk_counters(flat).join(arith, "fn")
    known = counters.withColumn("role", F.lit("unknown")) if roles is None else counters.drop("role").join(roles.select("fn", "role"), "fn", "left").fillna("unknown", ["role"])
    return evidence.semantic_risk(known)


def evidence_vectors(flat: DataFrame, roles: DataFrame | None = None, reach: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """What is known of each candidate: the walk with the effects of called functions and what callers taint, its source,
    path, slice, semantic risk, sink, uncertainty and contradictions. One row per candidate, shapes that look alike apart.

    roles (fn, role), reach (fn, reach) and entries (fn, entry_addr) are optional.
    """
    flat = graph.saved(flat)
    effects = taint.summaries(flat, entries, whole=True, met=True)
    walked = graph.saved(taint.analyze(flat, effects, taint.external_arguments(flat, effects, whole=True), entries, reach, whole=True))
    by_fn = walked.select("fn", (F.col("unknown_calls") > 0).alias("unknown_call"), F.exists("steps", lambda x: F.contains(x["reason"], F.lit("interproc"))).alias("interproc_confirmed"), F.exists("steps", lambda x: F.contains(F.lower(x["reason"]), F.lit("missing"))).alias("missing_summary"))
    # Source: the seed of the variable, else the surest seed of its path, else the name of its origin, else its confidence.
    outside = F.col("taint_source").startswith("external:") & ~F.col("taint_source").rlike("^external:(3a_seed|interproc)")
    named = F.when(outside, F.regexp_replace("taint_source", "^external:(llm_source:)?", ""))
    found = taint.candidates(walked).withColumns({"cand_id": F.xxhash64("fn", "seq", "vuln_type", "sink_fn", "taint_source"), "named": named, "best": F.greatest("var_conf", "path_conf")})
    # Each name's role once, not in every row.
    names = found.select(F.coalesce("seed_fn", "named").alias("name")).filter("name IS NOT NULL").distinct().withColumn("name_role", F.coalesce(sources.source_role(F.col("name")), F.lit("UNKNOWN")))
    names = graph.saved(names.withColumn("name_conf", sources.base_confidence(F.col("name_role"))))
    rows = found.join(by_fn, "fn").join(names, F.coalesce("seed_fn", "named") == names["name"], "left")
    reader = F.col("seed_fn").isNull() & F.col("named").isNotNull() & (F.col("name_role") == "UNKNOWN")  # what tainted it is a source of some kind
    rows = rows.withColumns(
        {
            "source_fn": F.coalesce("seed_fn", "named", "taint_source"),
            "source_role": F.when(reader, "LIBRARY_READER").otherwise(F.coalesce("name_role", F.when(F.col("best") > 0, sources.role_of_confidence(F.col("best"))), F.lit("UNKNOWN"))),
            "source_base_conf": F.when(reader, dims.SOURCE_CONFIDENCE["LIBRARY_READER"]).otherwise(F.coalesce("name_conf", "best")),
        }
    )
    # Semantic risk of the same type, else the strongest of the function.
    risk = semantic(flat, roles)
    same = risk.select("fn", "vuln_type", F.col("items").alias("same_items"))
    most = risk.groupBy("fn").agg(F.max_by("items", F.struct(F.size("items"), "vuln_type")).alias("most_items"))
    rows = rows.join(same, ["fn", "vuln_type"], "left").join(most, "fn", "left").withColumn("semantic_items", F.coalesce("same_items", "most_items", F.array().cast("array<string>")))
    if roles is not None:
        rows = rows.join(roles.select("fn", F.col("role").alias("semantic_role")), "fn", "left")
    if reach is not None:
        rows = rows.join(reach.select("fn", F.col("reach").cast("double").alias("reachability_score")), "fn", "left")
    if entries is not None:
        rows = rows.join(entries.select("fn", "entry_addr"), "fn", "left")
    no = F.lit(False)
    checked, mult, unknown = F.col("bounded") | F.col("checked"), F.col("mult"), F.col("source_role") == "UNKNOWN"
    forward, backward = (F.coalesce("sink_fn", F.lit("")) != "") & (F.col("seq") >= 0), F.coalesce(F.col("backward_conf") > 0, no)
    flags = F.struct(unknown.alias("unknown_source"), "unknown_call", "missing_summary", no.alias("incomplete_cfg"))
    return rows.select(
        "cand_id", "fn", F.col("entry_addr") if entries is not None else F.lit(None).cast("string").alias("entry_addr"), "seq", "vuln_type", "sink_fn", "match_kind", "confidence", "taint_source", "taint_var",
        sources.sink_class(F.coalesce("sink_fn", F.lit(""))).alias("sink_class"), "source_role", "source_fn", "source_base_conf", forward.alias("forward_reached"),
        F.when(F.col("hops") > 0, F.col("hops")).otherwise(F.size("taint_path")).alias("transformation_count"), mult.alias("path_has_mult"), checked.alias("path_checked"), F.col("freed").alias("path_freed"), "taint_path",
        backward.alias("backward_reached"), F.when(backward, sources.role_of_confidence(F.col("backward_conf"))).otherwise("").alias("backward_role"), F.coalesce("backward_depth", F.lit(0)).alias("backward_depth"),
        F.coalesce("semantic_role", F.lit("unknown")).alias("semantic_role") if roles is not None else F.lit("unknown").alias("semantic_role"), "semantic_items", F.size("semantic_items").cast("double").alias("semantic_score"),
        F.lit(0.0).alias("behavioral_similarity"), F.lit(0.5).alias("behavioral_prior_tp"), flags.alias("uncertainty"), evidence.is_uncertain(unknown, F.col("unknown_call"), F.col("missing_summary")).alias("uncertain"),
        evidence.contradictions(forward, F.size("semantic_items"), unknown, backward, checked, mult).alias("contradictions"), "interproc_confirmed",
        F.coalesce("reachability_score", F.lit(1.0)).alias("reachability_score") if reach is not None else F.lit(1.0).alias("reachability_score"),
        F.concat_ws(" ", F.col("vuln_type"), F.lit("at"), F.col("sink_fn"), F.lit("of"), F.col("taint_source")).alias("description"),
    )


def without_models(flat: DataFrame, **tables: DataFrame | None) -> DataFrame:
    """Findings of the deterministic path: each candidate with its evidence, whether its sink's evidence bears it out,
    calibrated confidence, and whether it is confirmed (a library match whose sink doesn't allocate); the surest of each
    (fn, vuln_type, sink_fn). Semantic risks that no candidate covers are appended, unconfirmed. tables are those of
    evidence_vectors."""
    vectors = graph.saved(evidence_vectors(flat, **tables))
    score = dims.rules(flat.sparkSession).select(F.col("rule_fn").alias("sink_fn"), "vuln_score")
    rows = vectors.join(F.broadcast(score), "sink_fn", "left")
    verdict = sources.verify_sink(F.col("sink_class"), F.col("source_base_conf"), F.col("path_has_mult"), F.col("path_checked"), F.col("path_freed"))
    conf = fuse.calibrated(fuse.signals(F.lit(0.5), F.col("match_kind"), F.coalesce("vuln_score", F.lit(0.0)), F.col("source_base_conf"), F.col("taint_source"), F.col("path_checked")))
    sure = (F.col("match_kind") == "LIBRARY_MATCH") & ~F.lower("sink_fn").contains("alloc")
    full = rows.select("fn", "vuln_type", "sink_fn", "cand_id", "match_kind", "taint_source", "source_role", verdict["emit"].alias("sink_verified"), verdict["tag"].alias("sink_evidence"), "contradictions", F.round(conf, 6).alias("confidence"), sure.alias("confirmed"), fuse.default_severity(F.col("vuln_type")).alias("severity"))
    best = select.keep_max(full, ["fn", "vuln_type", "sink_fn"], "confidence", "cand_id")
    return evidence.append_uncovered(best, semantic(flat, tables.get("roles"))).fillna(False, ["confirmed"])
