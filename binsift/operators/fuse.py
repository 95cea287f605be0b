"""Confidence, assessment and fusion arithmetic: column functions and the joins around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import CALIBRATION, SEVERITY, SHAPE_CONFIDENCE, SHAPE_EXTERNAL, SHAPE_FAMILIES, SHAPE_MATCH, SOURCE_TRUST, SOURCE_TRUST_DEFAULT
from ..functions.names import first_contained

# Levels of an assessment as factors, thresholds of fusion.
SUPPORT = {"Strong": 0.90, "Moderate": 0.75, "Weak": 0.35, "Unsupported": 0.10}
UNCERTAINTY = {"Low": 1.00, "Moderate": 0.88, "High": 0.70}
EXPLOITABILITY = {"High": 1.00, "Medium": 0.92, "Low": 0.80}
GAP, CONFIRM, SEMANTIC_CONFIRMED, SEMANTIC_KEPT = 0.35, 0.55, 0.60, 0.40
MATCH_BASE = {"LIBRARY_MATCH": 1.0, "STRUCTURAL_MATCH": 0.70, "NO_MATCH": 0.40}
VERIFIED = {"confirmed": 0.85, "weakly_confirmed": 0.65, "refuted": 0.20}


def lookup(value: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def signals(llm: Column, kind: Column, score: Column, taint: Column, source: Column, bounded: Column, status: Column | None = None) -> dict[str, Column]:
    """The five signals of calibration, each from 0 to 1."""
    pattern = lookup(kind, MATCH_BASE, 0.40) * F.least(F.lit(1.0), score / 8.0) * F.when(bounded, 0.80).otherwise(1.0)
    return {
        "llm": clamp(llm, 0.0, 1.0),
        "pattern": pattern,
        "taint": clamp(taint, 0.0, 1.0),
        "source": first_contained(F.lower(source), SOURCE_TRUST, SOURCE_TRUST_DEFAULT),
        "verification": F.lit(0.50) if status is None else lookup(status, VERIFIED, 0.50),
    }


def calibrated(found: dict[str, Column], weights: dict[str, float] = CALIBRATION, neutral: str | None = None) -> Column:
    """Weighted sum of signals from 0.05 to 0.99; `neutral` names one that counts as 0.5 (ablation)."""
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + (F.lit(0.5) if k == neutral else found[k]) * w
    return clamp(total, 0.05, 0.99)


def ablation(rows: DataFrame, found: dict[str, Column], key: str) -> DataFrame:
    """key, signal, confidence without it (one row for each signal and one, `none`, with all). Signals are computed once a
    row, not once for each that is left out."""
    once = rows.select(key, *[c.alias(f"_{k}") for k, c in found.items()])
    held = {k: F.col(f"_{k}") for k in found}
    parts = [F.struct(F.lit(k or "none").alias("signal"), F.round(calibrated(held, neutral=k), 6).alias("confidence")) for k in (None, *CALIBRATION)]
    return once.select(key, F.explode(F.array(*parts)).alias("a")).select(key, "a.signal", "a.confidence")


def uncertainty(quality: Column, model: Column) -> Column:
    """Overall uncertainty of evidence quality and model uncertainty."""
    return F.when((quality == "Poor") | (model == "High"), "High").when((quality == "Excellent") & (model == "Low"), "Low").otherwise("Moderate")


def uncertainty_confidence(overall: Column) -> Column:
    return lookup(overall, {"Low": 0.85, "Moderate": 0.60, "High": 0.35}, 0.50)


def agreement_score(signal_list: Column) -> Column:
    """Strong support 1, weak 0.5, contradiction -0.5, over the signals that aren't absent; 0 if all are."""
    n = lambda *v: F.size(F.filter(signal_list, lambda x: x.isin(*v)))
    active = F.size(F.filter(signal_list, lambda x: x != "absent"))
    return F.when(active == 0, 0.0).otherwise((n("strong_support") + n("weak_support") * 0.5 - n("contradicts") * 0.5) / active)


def agreement_level(score: Column) -> Column:
    return F.when(score >= 0.60, "High").when(score >= 0.30, "Medium").otherwise("Low")


def confirmed(support: Column, exploitability: Column, overall: Column) -> Column:
    return support.isin("Strong", "Moderate") & exploitability.isin("High", "Medium") & (overall != "High")


def severity(support: Column, exploitability: Column, impact: Column) -> Column:
    return F.when((support == "Strong") & (impact == "Critical"), "critical").when(support.isin("Strong", "Moderate") & (exploitability == "High"), "high").when(support == "Moderate", "medium").otherwise("low")


def memory_score(support: Column, overall: Column, exploitability: Column) -> Column:
    product = lookup(support, SUPPORT, 0.35) * lookup(overall, UNCERTAINTY, 0.88) * lookup(exploitability, EXPLOITABILITY, 0.90)
    return F.least(F.lit(1.0), product)


def semantic_score(n: Column, confirmed_max: Column, average: Column) -> Column:
    """0.5 without assessments; below it if none is confirmed; above it by the surest confirmed one."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.5).when(confirmed_max.isNull(), F.greatest(F.lit(0.15), average * 0.5)).otherwise(0.5 + confirmed_max * 0.45)


def posterior(prior: Column, evidence: Column) -> Column:
    """Bayes update of a prior by evidence of that likelihood; the prior where nothing is possible."""
    whole = evidence * prior + (1 - evidence) * (1 - prior)
    return F.when(whole < 1e-9, prior).otherwise(clamp(evidence * prior / whole, 0.0, 1.0))


def routing(memory: Column, semantic: Column, post: Column, has_semantic: Column) -> Column:
    direct = F.when(post >= CONFIRM, "bayes_direct_confirm").otherwise("bayes_direct_reject")
    return F.when(has_semantic & (F.abs(memory - semantic) > GAP), "needs_consensus").otherwise(direct)


def semantic_by_function(sem: DataFrame, kept: float = SEMANTIC_KEPT, sure: float = SEMANTIC_CONFIRMED) -> DataFrame:
    """Assessments of at least `kept` of each function: n, surest confirmed one, mean confidence (whole percents in)."""
    rows = sem.filter(F.col("conf_pct") >= kept * 100)
    return rows.groupBy("fn").agg(F.count("*").alias("n_sem"), (F.max(F.when(F.col("conf_pct") >= sure * 100, F.col("conf_pct"))) / 100).alias("sem_max"), (F.sum("conf_pct") / F.count("*") / 100).alias("sem_avg"))


def fuse(assessments: DataFrame, sem: DataFrame) -> DataFrame:
    """Each assessment with its memory and semantic score, posterior and routing. Semantic rows are summed by function
    before the join, so no pair of rows is made."""
    joined = assessments.join(semantic_by_function(sem), "fn", "left")
    mem = F.round(memory_score(F.col("support"), F.col("uncertainty"), F.col("exploitability")), 6)
    with_mem = joined.withColumn("memory_score", mem).withColumn("semantic_score", F.round(semantic_score(F.col("n_sem"), F.col("sem_max"), F.col("sem_avg")), 6))
    has = F.coalesce(F.col("n_sem"), F.lit(0)) > 0
    post = F.when(has, posterior(F.col("memory_score"), F.col("semantic_score"))).otherwise(F.col("memory_score"))
    scored = with_mem.withColumn("posterior", F.round(post, 6))
    return scored.withColumn("routing", routing(F.col("memory_score"), F.col("semantic_score"), F.col("posterior"), has))


def conflict(memory_confirmed: Column, n_semantic: Column, n_confirmed: Column) -> Column:
    has, ok = n_semantic > 0, n_confirmed > 0
    return F.when(memory_confirmed & ok, "agrees_vulnerable").when(~memory_confirmed & ~ok, "agrees_safe").when(memory_confirmed & ~has, "one_sided_memory").when(ok & ~memory_confirmed, "one_sided_semantic").otherwise("disagrees")


def verdict_confidence(kind: Column, confidence: Column) -> Column:
    """Confidence of the fast paths; a disagreement that no arbiter settles keeps 0.8 of the memory side's."""
    boosted = F.least(F.lit(1.0), confidence * 1.10)
    return F.when(kind == "agrees_vulnerable", boosted).when(kind == "agrees_safe", 0.20).when(kind.startswith("one_sided"), confidence * 0.90).otherwise(confidence * 0.80)


def direct_verdicts(fused: DataFrame, semantic_confirmed: DataFrame) -> DataFrame:
    """Finding rows of the direct routes: confirmed by route, severity one level up where a semantic bug of the function
    is confirmed. fused: fn, assess_id, posterior, routing, severity; semantic_confirmed: fn."""
    from .select import boosted

    direct = fused.filter("routing != 'needs_consensus'").join(semantic_confirmed.select("fn").distinct().withColumn("_sem", F.lit(True)), "fn", "left")
    return direct.select("fn", "assess_id", (F.col("routing") == "bayes_direct_confirm").alias("confirmed"), F.when(F.coalesce("_sem", F.lit(False)), boosted(F.col("severity"))).otherwise(F.col("severity")).alias("severity"), "posterior")


def merge(found: DataFrame, semantic_only: DataFrame, keys: list[str], conf: str, tie: str) -> DataFrame:
    """Findings without repeats (the surest of each key), then semantic ones whose (fn, vuln_type) none covers."""
    from .select import keep_max

    kept = keep_max(found, keys, conf, tie)
    more = semantic_only.join(kept.select("fn", "vuln_type").distinct(), ["fn", "vuln_type"], "left_anti")
    return kept.unionByName(more, allowMissingColumns=True)


def default_severity(vuln_type: Column) -> Column:
    out = F.lit("medium")
    for k, v in SEVERITY.items():
        out = F.when(vuln_type == k, v).otherwise(out)
    return out


def review_budget(learned: Column, hit_rate: Column) -> Column:
    """Reviews allowed: fewer as rules were learned and as they hit."""
    base = F.greatest(F.lit(5), F.least(F.lit(30), F.lit(30) - F.floor(learned / 5))).cast("int")
    return F.when(hit_rate > 0.8, F.greatest(F.lit(3), F.floor(base / 2))).when(hit_rate > 0.6, F.greatest(F.lit(4), F.floor(base * 0.75))).otherwise(base).cast("int")


def structural_fingerprint(vuln_type: Column, source: Column, sink: Column, kind: Column, conf: Column) -> Column:
    """Name-independent shape of a candidate: type, origin, sink family, match, confidence bucket, joined by |."""
    name = F.lower(F.coalesce(sink, F.lit("")))
    family = F.when(name == "", "unknown").otherwise(F.substring(name, 1, 20))
    for label, words in reversed(SHAPE_FAMILIES.items()):
        hit = [name.startswith(w[1:]) if w.startswith("^") else name.contains(w) for w in words]
        family = F.when(reduce(Column.__or__, hit), label).otherwise(family)
    bucket = F.lit(None).cast("string")
    for label, least in reversed(SHAPE_CONFIDENCE.items()):
        bucket = F.when(conf >= least, label).otherwise(bucket)
    origin = F.when(source.startswith("structural:"), "structural").otherwise(first_contained(source, [(x, "external") for x in SHAPE_EXTERNAL], "param"))
    match = F.lit("?")
    for label, word in SHAPE_MATCH.items():
        match = F.when(kind == label, word).otherwise(match)
    return F.concat_ws("|", vuln_type, origin, family, match, F.coalesce(bucket, F.lit("low")))


def calibrated_finding(rows: DataFrame, llm: str, kind: str, score: str, taint: str, source: str, bounded: str, status: str | None = None) -> DataFrame:
    """rows with `calibrated`: the weighted signals of each finding, named by its columns, to six places."""
    found = signals(F.col(llm), F.col(kind), F.col(score), F.col(taint), F.col(source), F.col(bounded), None if status is None else F.col(status))
    return rows.withColumn("calibrated", F.round(calibrated(found), 6))


def fallback_verdicts(rows: DataFrame) -> DataFrame:
    """Verdicts (memory_confirmed, confidence) of disagreements that no arbiter settles: the memory side's position at 0.8 of
    its confidence."""
    return rows.withColumn("confirmed", F.col("memory_confirmed")).withColumn("confidence", F.round(verdict_confidence(F.lit("disagrees"), F.col("confidence")), 6))
