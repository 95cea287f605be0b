"""Ranking, budgets, quotas, deduplication and sets of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import QUOTA_SHARE, ROLE_CATEGORY, ROLE_PATTERNS, SEVERITIES


def keep_max(rows: DataFrame, keys: Sequence[str], by: str, tie: str) -> DataFrame:
    """One row of each key: the greatest `by`, of equal ones the least `tie`."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(F.col(by), -F.col(tie))).alias("_b"))
    return best.select(*keys, "_b.*")


def keep_first(rows: DataFrame, keys: Sequence[str], order: str, *ties: str) -> DataFrame:
    """One row of each key: the first in emission order, of equal ones the least by ties."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(order, *ties)).alias("_b"))
    return best.select(*keys, "_b.*")


def round_robin(rows: DataFrame, score: str = "conf_pct", ties: Sequence[str] = ("cand_id",), kind: str = "match_kind") -> DataFrame:
    """fn_rank of each row in its function, and turn: functions take turns, library matches first."""
    own = Window.partitionBy("fn").orderBy(F.desc(score), *ties)
    ranked = rows.withColumn("fn_rank", F.row_number().over(own))
    return ranked.withColumn("library_first", (F.col(kind) != "LIBRARY_MATCH").cast("int"))


def dual_budget(rows: DataFrame, per_fn: int, total: int, score: str = "conf_pct", tie: str = "cand_id", least: int = 0) -> DataFrame:
    """At most per_fn rows of a function and total rows in all, in order of score; rows below `least` don't count.

    A function's rows are cut to per_fn first, so the total is a top-k of few rows from each function.
    """
    able = rows.filter(F.col(score) >= least)
    own = Window.partitionBy("fn").orderBy(F.desc(score), tie)
    return able.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= per_fn).drop("_n").orderBy(F.desc(score), tie).limit(total)


def profile(names: DataFrame, name: str) -> DataFrame:
    """Share of each budget category among names by their first matching role."""
    role = role_by_name(F.lower(name))
    mapped = F.create_map(*[F.lit(x) for kv in ROLE_CATEGORY.items() for x in kv])
    counts = names.select(mapped[role].alias("category")).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    # At most one row for each of the seven categories.
    return counts.select("category", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


def role_by_name(name: Column) -> Column:
    """First of the ordered roles with a pattern that the lower-cased name contains; null if none."""
    out = F.lit(None).cast("string")
    for role, patterns in reversed(ROLE_PATTERNS.items()):
        found = F.exists(F.array(*[F.lit(p) for p in patterns.split()]), lambda p: F.contains(name, p))
        out = F.when(found, role).otherwise(out)
    return out


def role_confidence(name: Column) -> Column:
    """0.90 if the first pattern found has six letters or more, else 0.75; null if none."""
    out = F.lit(None).cast("double")
    for patterns in reversed(ROLE_PATTERNS.values()):
        for p in reversed(patterns.split()):
            out = F.when(F.contains(name, F.lit(p)), 0.90 if len(p) >= 6 else 0.75).otherwise(out)
    return out


def adaptive_quotas(shares: dict[str, float], budget: int) -> dict[str, int]:
    """Slots of each category: base share times how common it is (from half to double), normalised, at least one; the
    slots that rounding leaves go to the largest, one each."""
    raw = {c: base * max(0.5, min(2.0, shares.get(c, 0.0) / max(base, 0.01))) for c, base in QUOTA_SHARE.items()}
    total = sum(raw.values())
    quotas = {c: max(1, int(v / total * budget)) for c, v in raw.items()}
    for c in sorted(quotas, key=lambda c: -quotas[c])[: max(0, budget - sum(quotas.values()))]:
        quotas[c] += 1
    return quotas


def by_quota(rows: DataFrame, quotas: dict[str, int], total: int, score: str, tie: str, category: str = "category") -> DataFrame:
    """The best rows of each category up to its quota, then the best of the rest up to the total.

    Of a category no more than its quota and the total can be among them, so Spark drops the rest before the shuffle."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    most = max(quotas.values(), default=0) + total
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(F.desc(score), tie))).filter(F.col("_n") <= most)
    filled = ranked.withColumn("filled", F.col("_n") > F.coalesce(quota[F.col(category)], F.lit(0))).drop("_n")
    return filled.orderBy("filled", F.desc(score), tie).limit(total)


def elbow(scores: DataFrame, score: str) -> DataFrame:
    """Threshold where descending scores level off: the first gap from the fifth on below half the mean gap, else the
    score a quarter down; the greatest score of fewer than ten rows. One row: threshold.

    Scores are rounded, so equal ones are counted first and only distinct ones (a bounded number, whatever the rows)
    meet in one task. Gaps between equal scores are 0, and the mean gap follows from the ends.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("s"))
    groups = scores.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    placed = groups.select("s", "c", (F.sum("c").over(w) - F.col("c")).alias("start"), (F.col("s") - F.lead("s").over(w)).alias("gap"), F.lead("s").over(w).isNull().alias("final"))
    stats = groups.agg(F.sum("c").alias("n"), F.max("s").alias("most"), F.min("s").alias("least"))
    rows = placed.join(F.broadcast(stats)).withColumn("mean", F.try_divide(F.col("most") - F.col("least"), F.col("n") - 1)).withColumn("end", F.col("start") + F.col("c") - 1)
    inner = F.when((F.col("mean") > 0) & (F.greatest(F.lit(5), "start") < F.col("end")), F.greatest(F.lit(5), "start"))
    outer = F.when(~F.col("final") & (F.col("end") >= 5) & (F.col("gap") < 0.5 * F.col("mean")), F.col("end"))
    first = F.coalesce(F.least(inner, outer), inner, outer)
    quarter = F.when((F.floor(F.col("n") / 4) >= F.col("start")) & (F.floor(F.col("n") / 4) <= F.col("end")), F.col("s"))
    one = rows.agg(F.min_by("s", first).alias("level"), F.max(quarter).alias("quarter"), F.first("n").alias("n"), F.first("most").alias("most"))
    return one.select(F.when(F.col("n") < 10, F.col("most")).otherwise(F.coalesce("level", "quarter")).alias("threshold"))


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical."""
    return (F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), severity) - 1).cast("int")


def boosted(severity: Column) -> Column:
    """One level up, critical at most."""
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), F.least(severity_rank(severity) + 2, F.lit(len(SEVERITIES))))


def without_suppressed(rows: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Findings that no suppression covers: by the exact triple, by function and type whatever the sink, or by function
    where the suppression names no type. Three equi anti joins instead of one with OR."""
    s = suppressed.select("fn", "vuln_type").distinct()
    pair = rows.join(s, ["fn", "vuln_type"], "left_anti")
    whole = s.filter("vuln_type = ''").select("fn")
    return pair.join(whole, "fn", "left_anti")


def with_extras(chosen: DataFrame, extras: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both, one row of a key (the chosen one's), in order."""
    more = extras.join(chosen.select(key), key, "left_anti")
    return chosen.unionByName(more).orderBy(F.desc(order), key)


# Vulnerability types in scope.
IN_SCOPE = "buffer_overflow heap_overflow out_of_bounds_read out_of_bounds_write integer_overflow integer_underflow integer_truncation null_dereference write_what_where check_bypass unchecked_arithmetic logic_bug".split()


def in_scope(rows: DataFrame, confirmed: Column) -> DataFrame:
    """Rows without confirmed ones of a type out of scope."""
    return rows.filter(~confirmed | F.col("vuln_type").isin(IN_SCOPE))


def library_first(rows: DataFrame, n: int, score: str = "conf_pct", tie: str = "cand_id") -> DataFrame:
    """The first n rows: library matches, then by score."""
    return rows.orderBy(F.col("match_kind") != "LIBRARY_MATCH", F.desc(score), tie).limit(n)


def screening(functions: DataFrame, counts: DataFrame, n: int, least: float, score: str = "score") -> DataFrame:
    """The first n functions (fn, score) to screen: those without candidates (counts: fn, n) first, each kind by score, from
    `least` on."""
    rows = functions.join(counts, "fn", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col(score) >= least)
    return rows.orderBy(F.col("n") > 0, F.desc(score), "fn").limit(n)


def capped(rows: DataFrame, n: int = 500, score: str = "conf_pct", tie: str = "cand_id") -> DataFrame:
    """The n surest rows."""
    return rows.orderBy(F.desc(score), tie).limit(n)


def uncovered(rows: DataFrame, by: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys no row of the other table has."""
    return rows.join(by.select(*keys).distinct(), list(keys), "left_anti")


def both_sides(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: hit (keys in both), missed (only in truth), extra (only in found)."""
    sides = truth.select(key).distinct().withColumn("_t", F.lit(1)).join(found.select(key).distinct().withColumn("_f", F.lit(1)), key, "full")
    t, f = F.col("_t").isNotNull(), F.col("_f").isNotNull()
    return sides.agg(F.count_if(t & f).alias("hit"), F.count_if(t & ~f).alias("missed"), F.count_if(~t & f).alias("extra"))


def evaluation_set(named: DataFrame, truth: DataFrame, dangerous: DataFrame, budget: int) -> DataFrame:
    """fn, phase of the functions to evaluate on: the named ones, then those of the ground truth, then others with dangerous
    calls, each name once, in order of phase and name, `budget` in all. Each table: fn."""
    phases = [named.select("fn", F.lit(0).alias("phase")), truth.select("fn", F.lit(1).alias("phase")), dangerous.select("fn", F.lit(2).alias("phase"))]
    rows = phases[0].unionByName(phases[1]).unionByName(phases[2]).groupBy("fn").agg(F.min("phase").alias("phase"))
    return rows.orderBy("phase", "fn").limit(budget)


def final_findings(rows: DataFrame, conf: str, *ties: str) -> DataFrame:
    """Findings with place (1, 2, ...), the surest first."""
    from .report import in_order

    return in_order(rows, F.desc(conf), *map(F.col, ties)).withColumnRenamed("order", "place")
