"""What surrounds the answers of external services: whom to ask, how much, in which order, and what to keep.

A service is a function from a DataFrame of questions to the answers of `sources.external.SCHEMAS`; nothing here calls a
model. Every question goes through a `Ledger`: answers are written before they are used, so a service is asked once for
each question, however often its answers are read, and with a ledger that the caller keeps also across runs and failures.
Budgets and thresholds are those of the callers' stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import external
from . import evidence, fuse, select
from .ledger import Ledger

# Budgets (all, a function) and least confidence of the stages that ask.
REVIEW, REVIEW_LEAST = (40, 4), 0.50
ASSESS, ASSESS_LEAST = (40, 4), 0.35
SCREEN, SCREEN_LEAST = 15, 0.30
ANALYSES = ["arithmetic", "bounds", "lifetime", "control_flow", "interface"]


def _ask(ledger: Ledger | None, kind: str, questions: DataFrame, service: external.Service | None, on: list[str], name: str = "default") -> DataFrame:
    return (ledger or Ledger(questions.sparkSession)).ask(kind, questions, service, on, name)


def callee_names(targets: DataFrame, service: external.Service | None, ledger: Ledger | None = None) -> DataFrame:
    """target, name: the name that a service gives an unknown call target, null where it gives none or only the target
    itself back."""
    got = _ask(ledger, "callee_names", targets.select("target").distinct(), service, ["target"])
    name = F.nullif(F.trim("name"), F.lit(""))
    return targets.select("target").distinct().join(got.select("target", F.when(name != F.col("target"), name).alias("name")), "target", "left")


def summaries(unknown: DataFrame, cache: DataFrame, signs: DataFrame, service: external.Service | None, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries of unknown functions that their own operations bear out, and the cache with what was asked now.

    Only functions that the cache doesn't hold are asked; an answer without a role is cached too and not asked again. A
    role that the operations refute is dropped, one they bear out weakly counts less. signs: evidence.role_signs.
    """
    asked = unknown.select("fn").distinct().join(cache.select("fn"), "fn", "left_anti")
    got = _ask(ledger, "summaries", asked, service, ["fn"])
    fresh = asked.join(got, "fn", "left")
    whole = cache.select(*fresh.columns).unionByName(fresh)
    known = whole.filter("likely_role IS NOT NULL").join(unknown.select("fn").distinct(), "fn", "left_semi").join(signs, "fn")
    verdict = evidence.verify_role(F.col("likely_role"), F.col("fn"), F.lit(0), F.lit(0), F.lit(False))
    checked = known.withColumn("_v", verdict).filter(F.col("_v.multiplier") > 0)
    kept = checked.withColumn("confidence", F.round(F.coalesce("confidence", F.lit(0.6)) * F.col("_v.multiplier"), 6)).withColumn("status", F.col("_v.status"))
    return kept.select(*fresh.columns, "status"), whole


def learned_effects(kept: DataFrame) -> DataFrame:
    """What summaries teach the walk: fn, arg, effect (`checks`, `external`)."""
    one = lambda c, e: kept.select("fn", F.explode(c).alias("arg"), F.lit(e).alias("effect"))
    return one("marks_checked_args", "checks").unionByName(one("external_source_args", "external"))


def reviewed(candidates: DataFrame, service: external.Service | None, score: str = "conf_pct", tie: str = "cand_id", ledger: Ledger | None = None) -> DataFrame:
    """Candidates with a review: the best of each function and of all are asked, the rest have none; a review is kept
    from a confidence of REVIEW_LEAST on."""
    asked = select.dual_budget(candidates, REVIEW[1], REVIEW[0], score, tie, least=int(100 * REVIEW_LEAST))
    got = _ask(ledger, "reviews", asked, service, [tie])
    return asked.join(got.withColumnRenamed("confidence", "review_confidence"), tie, "left").filter(F.col("review_confidence") >= REVIEW_LEAST)


def assessed(candidates: DataFrame, service: external.Service | None, score: str = "conf_pct", tie: str = "cand_id", ledger: Ledger | None = None) -> DataFrame:
    """Candidates with the assessment of a peer review."""
    asked = select.dual_budget(candidates, ASSESS[1], ASSESS[0], score, tie, least=int(100 * ASSESS_LEAST))
    return asked.join(_ask(ledger, "assessments", asked, service, [tie]), tie)


def screened(functions: DataFrame, counts: DataFrame, service: external.Service | None, ledger: Ledger | None = None) -> DataFrame:
    """Logic findings of the functions that screening picks: those without candidates first."""
    asked = select.screening(functions, counts, SCREEN, SCREEN_LEAST)
    return _ask(ledger, "logic_findings", asked, service, ["fn"]).filter("found")


def chained(functions: DataFrame, service: external.Service | None, analyses: list[str] | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Answers of the analyses, one after another: each is asked with what the ones before concluded of the function
    (seen: array of analysis_type and vuln_type). Answers of SEMANTIC_KEPT confidence or more are kept. After a failure a
    run with the same ledger goes on where the last one ended."""
    known, ledger = None, ledger or Ledger(functions.sparkSession)
    for name in analyses or ANALYSES:
        if known is None:
            asked = functions.withColumn("seen", F.array().cast("array<struct<analysis_type:string,vuln_type:string>>"))
        else:
            so_far = known.groupBy("fn").agg(F.sort_array(F.collect_list(F.struct("analysis_type", "vuln_type"))).alias("seen"))
            asked = functions.join(so_far, "fn", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<analysis_type:string,vuln_type:string>>")))
        got = ledger.ask("semantic_assessments", asked.withColumn("analysis_type", F.lit(name)), service, ["fn"], name).withColumn("analysis_type", F.lit(name))
        known = got if known is None else known.unionByName(got)
    return known.filter(F.col("confidence") >= fuse.SEMANTIC_KEPT)


def arbitrated(rows: DataFrame, service: external.Service | None, key: str = "cand_id", ledger: Ledger | None = None) -> DataFrame:
    """Rows (key, kind of conflict, confidence) with a verdict: disagreements by the arbiter where it answers, everything
    else by the fast paths."""
    got = _ask(ledger, "verdicts", rows.filter("kind = 'disagrees'"), service, [key])
    both = rows.join(got.select(key, F.col("confirmed").alias("_yes"), F.col("confidence").alias("_conf")), key, "left")
    plain = F.col("kind").isin("agrees_vulnerable", "one_sided_memory", "one_sided_semantic")
    return both.select(key, "kind", F.coalesce("_yes", plain).alias("confirmed"), F.round(F.coalesce("_conf", fuse.verdict_confidence(F.col("kind"), F.col("confidence"))), 6).alias("confidence"))
