"""Queries over candidates, assessments, findings, logs and store tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import evidence, fuse, metrics, ops, report, select, sources, store
from .base import Source, query
from .on_rules import PROFILE

_MEM = "round(least(1.0, CASE support WHEN 'Strong' THEN 0.9 WHEN 'Moderate' THEN 0.75 WHEN 'Weak' THEN 0.35 ELSE 0.1 END::DOUBLE * CASE uncertainty WHEN 'Low' THEN 1.0 WHEN 'High' THEN 0.7 ELSE 0.88 END::DOUBLE * CASE exploitability WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.92 ELSE 0.8 END::DOUBLE), 6)"
_FUSED = f"""s AS (SELECT fn, count(*) AS n, max(CASE WHEN conf_pct >= 60 THEN conf_pct END) / 100 AS mx, sum(conf_pct) / count(*) / 100 AS av FROM b_sem WHERE conf_pct >= 40 GROUP BY fn),
m AS (SELECT a.*, {_MEM} AS memory_score, round(CASE WHEN s.n IS NULL THEN 0.5 WHEN s.mx IS NULL THEN greatest(0.15, s.av * 0.5) ELSE 0.5 + s.mx * 0.45 END::DOUBLE, 6) AS semantic_score, s.n AS n_sem FROM b_assess a LEFT JOIN s ON s.fn = a.fn),
p AS (SELECT *, round(CASE WHEN n_sem IS NULL THEN memory_score ELSE semantic_score * memory_score / (semantic_score * memory_score + (1 - semantic_score) * (1 - memory_score)) END, 6) AS posterior FROM m),
fz AS (SELECT fn, assess_id, memory_score, semantic_score, posterior, CASE WHEN n_sem IS NOT NULL AND abs(memory_score - semantic_score) > 0.35 THEN 'needs_consensus' WHEN posterior >= 0.55 THEN 'bayes_direct_confirm' ELSE 'bayes_direct_reject' END AS routing FROM p)"""


def _fused(s: Source) -> DataFrame:
    return fuse.fuse(s.b_assess, s.b_sem).select("fn", "assess_id", "memory_score", "semantic_score", "posterior", "routing")


@query("f10_bayes_fusion", f"WITH {_FUSED} SELECT * FROM fz")
def f10(s: Source) -> DataFrame:
    return _fused(s)


@query("a15_routing_metrics", f"WITH {_FUSED} SELECT count(*) AS n, count_if(routing = 'needs_consensus') AS consensus, count_if(routing = 'bayes_direct_confirm') AS direct_confirm, count_if(routing = 'bayes_direct_reject') AS direct_reject, round(count_if(routing = 'needs_consensus') / count(*), 4) AS consensus_rate, round(count_if(routing <> 'needs_consensus') * 100 / count(*), 2) AS saved_pct FROM fz")
def a15(s: Source) -> DataFrame:
    return metrics.routing_metrics(_fused(s))


@query("f04_confirmed_severity", """
SELECT assess_id, support IN ('Strong', 'Moderate') AND exploitability IN ('High', 'Medium') AND uncertainty <> 'High' AS confirmed,
  CASE WHEN support = 'Strong' AND uncertainty = 'Low' THEN 'critical' WHEN support IN ('Strong', 'Moderate') AND exploitability = 'High' THEN 'high' WHEN support = 'Moderate' THEN 'medium' ELSE 'low' END AS severity FROM b_assess""")
def f04(s: Source) -> DataFrame:
    impact = F.when(F.col("uncertainty") == "Low", "Critical").otherwise("Limited")
    return s.b_assess.select("assess_id", fuse.confirmed(F.col("support"), F.col("exploitability"), F.col("uncertainty")).alias("confirmed"), fuse.severity(F.col("support"), F.col("exploitability"), impact).alias("severity"))


_TRUST = "CASE " + " ".join(f"WHEN contains(src, '{k}') THEN {v}::DOUBLE" for k, v in dims.SOURCE_TRUST) + f" ELSE {dims.SOURCE_TRUST_DEFAULT}::DOUBLE END"
_SRCS = "CASE cand_id % 5 WHEN 0 THEN 'external:fread' WHEN 1 THEN 'param:VAR_0' WHEN 2 THEN 'structural:callind' WHEN 3 THEN 'unknown_call:x' ELSE 'zzz' END"
_SIG = f"SELECT cand_id, conf_pct / 100 AS llm, CASE match_kind WHEN 'LIBRARY_MATCH' THEN 1.0 WHEN 'STRUCTURAL_MATCH' THEN 0.7 ELSE 0.4 END::DOUBLE * least(1.0, (cand_id % 10) / 8) * CASE WHEN cand_id % 2 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS pat, (cand_id % 11) / 10 AS tnt, {_TRUST} AS srcs FROM (SELECT *, {_SRCS} AS src FROM b_candidates) c"


def _signals() -> dict:
    k = F.col("cand_id") % 5
    src = F.when(k == 0, "external:fread").when(k == 1, "param:VAR_0").when(k == 2, "structural:callind").when(k == 3, "unknown_call:x").otherwise("zzz")
    return fuse.signals(F.col("conf_pct") / 100, F.col("match_kind"), F.col("cand_id") % 10, (F.col("cand_id") % 11) / 10, src, F.col("cand_id") % 2 == 0)


@query("f01_calibrated_confidence", f"SELECT cand_id, round(greatest(0.05, least(0.99, 0.4 * llm + 0.25 * pat + 0.2 * least(1.0, tnt) + 0.1 * srcs + 0.05 * 0.5)), 6)::DOUBLE AS confidence FROM ({_SIG}) t")
def f01(s: Source) -> DataFrame:
    return s.b_candidates.select("cand_id", F.round(fuse.calibrated(_signals()), 6).alias("confidence"))


@query("f02_ablation", f"""
SELECT cand_id, signal, round(greatest(0.05, least(0.99, 0.4 * CASE WHEN signal = 'llm' THEN 0.5 ELSE llm END + 0.25 * CASE WHEN signal = 'pattern' THEN 0.5 ELSE pat END + 0.2 * CASE WHEN signal = 'taint' THEN 0.5 ELSE least(1.0, tnt) END + 0.1 * CASE WHEN signal = 'source' THEN 0.5 ELSE srcs END + 0.05 * 0.5)), 6)::DOUBLE AS confidence
FROM ({_SIG}) t, (VALUES ('none'), ('llm'), ('pattern'), ('taint'), ('source'), ('verification')) v(signal)""")
def f02(s: Source) -> DataFrame:
    return fuse.ablation(s.b_candidates, _signals(), "cand_id")


@query("f03_uncertainty_confidence", """
SELECT cand_id, CASE WHEN q = 'Poor' OR m = 'High' THEN 'High' WHEN q = 'Excellent' AND m = 'Low' THEN 'Low' ELSE 'Moderate' END AS overall, CASE WHEN q = 'Poor' OR m = 'High' THEN 0.35 WHEN q = 'Excellent' AND m = 'Low' THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence
FROM (SELECT cand_id, CASE cand_id % 3 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Good' ELSE 'Excellent' END AS q, CASE cand_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Moderate' ELSE 'Low' END AS m FROM b_candidates) t""")
def f03(s: Source) -> DataFrame:
    q = F.when(F.col("cand_id") % 3 == 0, "Poor").when(F.col("cand_id") % 3 == 1, "Good").otherwise("Excellent")
    m = F.when(F.col("cand_id") % 4 == 0, "High").when(F.col("cand_id") % 4 == 1, "Moderate").otherwise("Low")
    rows = s.b_candidates.select("cand_id", fuse.uncertainty(q, m).alias("overall"))
    return rows.select("cand_id", "overall", fuse.uncertainty_confidence(F.col("overall")).alias("confidence"))


@query("a23_agreement", """
WITH g AS (SELECT cand_id, [CASE (cand_id + i * 7) % 5 WHEN 0 THEN 'strong_support' WHEN 1 THEN 'weak_support' WHEN 2 THEN 'contradicts' WHEN 3 THEN 'insufficient' ELSE 'absent' END FOR i IN range(5)] AS s FROM b_candidates),
n AS (SELECT cand_id, len([x FOR x IN s IF x = 'strong_support']) AS st, len([x FOR x IN s IF x = 'weak_support']) AS w, len([x FOR x IN s IF x = 'contradicts']) AS c, len([x FOR x IN s IF x <> 'absent']) AS a FROM g),
v AS (SELECT cand_id, CASE WHEN a = 0 THEN 0.0 ELSE (st + w * 0.5 - c * 0.5) / a END::DOUBLE AS sc FROM n)
SELECT cand_id, round(sc, 6) AS score, CASE WHEN sc >= 0.6 THEN 'High' WHEN sc >= 0.3 THEN 'Medium' ELSE 'Low' END AS level FROM v""")
def a23(s: Source) -> DataFrame:
    one = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("strong_support", "weak_support", "contradicts", "insufficient", "absent")]), ((F.col("cand_id") + i * 7) % 5 + 1).cast("int"))
    rows = s.b_candidates.select("cand_id", fuse.agreement_score(F.array(*[one(i) for i in range(5)])).alias("sc"))
    return rows.select("cand_id", F.round("sc", 6).alias("score"), fuse.agreement_level(F.col("sc")).alias("level"))


@query("f12_conflict_class", """
WITH s AS (SELECT fn, count(*) AS n, count_if(conf_pct >= 60) AS c FROM b_sem WHERE conf_pct >= 40 GROUP BY fn),
t AS (SELECT assess_id, support IN ('Strong', 'Moderate') AND exploitability IN ('High', 'Medium') AND uncertainty <> 'High' AS m, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM b_assess a LEFT JOIN s ON s.fn = a.fn),
k AS (SELECT assess_id, CASE WHEN m AND c > 0 THEN 'agrees_vulnerable' WHEN NOT m AND c = 0 THEN 'agrees_safe' WHEN m AND n = 0 THEN 'one_sided_memory' WHEN c > 0 AND NOT m THEN 'one_sided_semantic' ELSE 'disagrees' END AS kind FROM t)
SELECT assess_id, kind, round(CASE WHEN kind = 'agrees_vulnerable' THEN least(1.0, 0.66) WHEN kind = 'agrees_safe' THEN 0.2 WHEN starts_with(kind, 'one_sided') THEN 0.54 ELSE 0.48 END::DOUBLE, 6) AS confidence FROM k""")
def f12(s: Source) -> DataFrame:
    g = s.b_sem.filter("conf_pct >= 40").groupBy("fn").agg(F.count("*").alias("n"), F.count_if(F.col("conf_pct") >= 60).alias("c"))
    m = fuse.confirmed(F.col("support"), F.col("exploitability"), F.col("uncertainty"))
    rows = s.b_assess.join(g, "fn", "left").select("assess_id", fuse.conflict(m, F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0))).alias("kind"))
    return rows.select("assess_id", "kind", F.round(fuse.verdict_confidence(F.col("kind"), F.lit(0.6)), 6).alias("confidence"))


@query("f17_review_budget", "SELECT c_custkey, CAST(CASE WHEN h > 0.8 THEN greatest(3, b // 2) WHEN h > 0.6 THEN greatest(4, floor(b * 0.75)) ELSE b END AS INTEGER) AS budget FROM (SELECT c_custkey, greatest(5, least(30, 30 - c_custkey // 5)) AS b, (c_custkey % 10) / 10 AS h FROM customer) t")
def f17(s: Source) -> DataFrame:
    return s.customer.select("c_custkey", fuse.review_budget(F.col("c_custkey"), F.col("c_custkey") % 10 / 10).alias("budget"))


@query("p22_structural_fingerprint", """
SELECT vuln_type || '|param|' || CASE sink_fn WHEN 'memcpy' THEN 'memcpy_family' WHEN 'malloc' THEN 'malloc_family' ELSE lower(sink_fn) END || '|' || CASE match_kind WHEN 'LIBRARY_MATCH' THEN 'lib' WHEN 'STRUCTURAL_MATCH' THEN 'struct' ELSE 'heur' END || '|' || CASE WHEN conf_pct >= 70 THEN 'high' WHEN conf_pct >= 45 THEN 'med' ELSE 'low' END AS shape, count(*) AS n FROM b_candidates GROUP BY 1""")
def p22(s: Source) -> DataFrame:
    shape = fuse.structural_fingerprint(F.col("vuln_type"), F.lit("param:VAR_0"), F.col("sink_fn"), F.col("match_kind"), F.col("conf_pct") / 100)
    return s.b_candidates.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


_SEV = "CASE vuln_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.SEVERITY.items()) + " ELSE 'medium' END"


@query("p29_severity_map", f"SELECT vuln_type, {_SEV} AS severity, CASE {_SEV} WHEN 'medium' THEN 'high' ELSE 'critical' END AS boosted, count(*) AS n FROM b_candidates GROUP BY 1, 2, 3")
def p29(s: Source) -> DataFrame:
    rows = s.b_candidates.withColumn("severity", fuse.default_severity(F.col("vuln_type")))
    return rows.groupBy("vuln_type", "severity", select.boosted(F.col("severity")).alias("boosted")).agg(F.count("*").alias("n"))


@query("p21_in_scope", "SELECT cand_id FROM b_candidates WHERE NOT (conf_pct > 60) OR vuln_type IN ('buffer_overflow', 'heap_overflow', 'out_of_bounds_read', 'out_of_bounds_write', 'integer_overflow', 'integer_underflow', 'integer_truncation', 'null_dereference', 'write_what_where', 'check_bypass', 'unchecked_arithmetic', 'logic_bug')")
def p21(s: Source) -> DataFrame:
    return select.in_scope(s.b_candidates, F.col("conf_pct") > 60).select("cand_id")


@query("p25_confidence_role", "SELECT cand_id, CASE WHEN abs(c - 1) < 0.06 THEN 'DIRECT_IO' WHEN abs(c - 0.98) < 0.06 THEN 'NETWORK_WRAPPED' WHEN abs(c - 0.9) < 0.06 THEN 'LIBRARY_READER' WHEN abs(c - 0.85) < 0.06 THEN 'DB_INPUT' WHEN abs(c - 0.75) < 0.06 THEN 'CLI_ARGUMENT' WHEN abs(c - 0.65) < 0.06 THEN 'ENVIRONMENT' ELSE 'UNKNOWN' END AS role FROM (SELECT cand_id, conf_pct / 100 AS c FROM b_candidates) t")
def p25(s: Source) -> DataFrame:
    return s.b_candidates.select("cand_id", sources.role_of_confidence(F.col("conf_pct") / 100).alias("role"))


@query("a18_dedup_keep_max", "SELECT fn, vuln_type, sink_fn, cand_id, match_kind, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY fn, vuln_type, sink_fn ORDER BY conf_pct DESC, cand_id) AS n FROM b_candidates) t WHERE n = 1")
def a18(s: Source) -> DataFrame:
    return select.keep_max(s.b_candidates, ["fn", "vuln_type", "sink_fn"], "conf_pct", "cand_id")


@query("a19_dedup_keep_first", "SELECT fn, vuln_type, sink_fn, cand_id, match_kind, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY fn, vuln_type, sink_fn ORDER BY cand_id) AS n FROM b_candidates) t WHERE n = 1")
def a19(s: Source) -> DataFrame:
    return select.keep_first(s.placed("b_candidates"), ["fn", "vuln_type", "sink_fn"], "cand_id", "place").drop("place")


@query("a20_first_wins_fingerprint", "SELECT skey, min(fn) AS fn FROM (SELECT fn, sha256(string_agg(op, ' ' ORDER BY seq))[1:16] AS skey FROM b_ops GROUP BY fn) t GROUP BY skey")
def a20(s: Source) -> DataFrame:
    keys = ops.ordered_hash(s.b_ops, F.col("op"), "skey")
    return select.keep_first(keys, ["skey"], "fn")


@query("a21_upsert_counts", """
SELECT fn, vuln_type, count(*) AS seen_count, max(conf_pct) AS conf_pct, arg_max(reason, cand_id) FILTER (WHERE reason <> '') AS reason
FROM (SELECT *, CASE WHEN cand_id % 3 = 0 THEN '' ELSE 'r' || CAST(cand_id AS VARCHAR) END AS reason FROM b_candidates) t GROUP BY fn, vuln_type""")
def a21(s: Source) -> DataFrame:
    events = s.b_candidates.withColumn("reason", F.when(F.col("cand_id") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("cand_id").cast("string"))))
    return store.counted(events, ["fn", "vuln_type"], "cand_id", "conf_pct", "reason")


@query("a21b_merge_counts", "SELECT fn, count(*) AS seen_count, max(conf_pct) AS conf_pct FROM b_candidates GROUP BY fn")
def a21b(s: Source) -> DataFrame:
    part = lambda k: store.counted(s.b_candidates.filter(F.col("cand_id") % 2 == k), ["fn"], "cand_id", "conf_pct")
    return store.merged(part(0), part(1), ["fn"])


@query("k01_put_latest", "SELECT fn, arg_max(cand_id, cand_id) AS cand_id, arg_max(sink_fn, cand_id) AS sink_fn FROM b_candidates GROUP BY fn")
def k01(s: Source) -> DataFrame:
    rows = s.b_candidates.select("fn", "cand_id", "sink_fn")
    return store.latest(rows.filter("cand_id % 2 = 0"), rows.filter("cand_id % 2 = 1"), ["fn"], "cand_id")


@query("k07_clear_suppression", "SELECT cand_id FROM b_candidates WHERE (fn, vuln_type) NOT IN (SELECT fn, vuln_type FROM b_candidates WHERE conf_pct = 100)")
def k07(s: Source) -> DataFrame:
    gone = s.b_candidates.filter("conf_pct = 100").select("fn", "vuln_type").distinct()
    return store.cleared(s.b_candidates, gone, ["fn", "vuln_type"]).select("cand_id")


@query("j11_suppressions", """
WITH s AS (SELECT fn, CASE WHEN cand_id % 4 = 0 THEN '' ELSE vuln_type END AS vuln_type FROM b_candidates WHERE cand_id % 997 = 0)
SELECT cand_id FROM b_candidates c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.fn = c.fn AND (s.vuln_type = c.vuln_type OR s.vuln_type = ''))""")
def j11(s: Source) -> DataFrame:
    sup = s.b_candidates.filter("cand_id % 997 = 0").select("fn", F.when(F.col("cand_id") % 4 == 0, "").otherwise(F.col("vuln_type")).alias("vuln_type"), "sink_fn")
    return select.without_suppressed(s.b_candidates, sup).select("cand_id")


@query("j12_supersede", "SELECT cand_id, 'new' AS origin FROM b_candidates WHERE match_kind = 'LIBRARY_MATCH' UNION ALL SELECT cand_id, 'old' FROM b_candidates c WHERE match_kind <> 'LIBRARY_MATCH' AND (fn, vuln_type, sink_fn) NOT IN (SELECT fn, vuln_type, sink_fn FROM b_candidates WHERE match_kind = 'LIBRARY_MATCH')")
def j12(s: Source) -> DataFrame:
    new, old = s.b_candidates.filter("match_kind = 'LIBRARY_MATCH'"), s.b_candidates.filter("match_kind != 'LIBRARY_MATCH'")
    rest = store.cleared(old, new.select("fn", "vuln_type", "sink_fn").distinct(), ["fn", "vuln_type", "sink_fn"])
    return new.select("cand_id", F.lit("new").alias("origin")).unionByName(rest.select("cand_id", F.lit("old").alias("origin")))


@query("j13_assessment_semantic", "SELECT a.assess_id, s.sem_id, s.conf_pct FROM b_assess a JOIN b_sem s ON s.fn = a.fn WHERE s.conf_pct >= 40")
def j13(s: Source) -> DataFrame:
    return s.b_assess.join(s.b_sem.filter("conf_pct >= 40"), "fn").select("assess_id", "sem_id", "conf_pct")


@query("j14_semantic_only", "SELECT sem_id FROM b_sem WHERE fn NOT IN (SELECT fn FROM b_assess WHERE support = 'Strong')")
def j14(s: Source) -> DataFrame:
    return select.uncovered(s.b_sem, s.b_assess.filter("support = 'Strong'"), ["fn"]).select("sem_id")


@query("w03_round_robin", "SELECT cand_id, CAST(row_number() OVER (PARTITION BY fn ORDER BY conf_pct DESC, cand_id, vuln_type, match_kind) AS INTEGER) AS fn_rank, CAST(match_kind <> 'LIBRARY_MATCH' AS INTEGER) AS library_first FROM b_candidates")
def w03(s: Source) -> DataFrame:
    return select.round_robin(s.b_candidates, ties=("cand_id", "vuln_type", "match_kind")).select("cand_id", "fn_rank", "library_first")


@query("w04_dual_budget", "SELECT cand_id, fn, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY conf_pct DESC, cand_id) AS n FROM b_candidates WHERE conf_pct >= 35) t WHERE n <= 4 ORDER BY conf_pct DESC, cand_id LIMIT 40")
def w04(s: Source) -> DataFrame:
    return select.dual_budget(s.b_candidates, 4, 40, least=35).select("cand_id", "fn", "conf_pct")


_SHARES = {"parser": 0.4, "validator": 0.1, "arithmetic": 0.2, "memory": 0.3}
_QUOTAS = select.adaptive_quotas(_SHARES, 75)
_CATEGORY = "CASE cand_id % 7 WHEN 0 THEN 'parser' WHEN 1 THEN 'validator' WHEN 2 THEN 'arithmetic' WHEN 3 THEN 'memory' WHEN 4 THEN 'unknown' WHEN 5 THEN 'state_machine' ELSE 'error_handler' END"
_QUOTA_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _QUOTAS.items()) + " ELSE 0 END"


@query("w05_category_quota", f"""
WITH r AS (SELECT cand_id, conf_pct, category, row_number() OVER (PARTITION BY category ORDER BY conf_pct DESC, cand_id) AS n FROM (SELECT *, {_CATEGORY} AS category FROM b_candidates) t),
c AS (SELECT *, n <= {_QUOTA_CASE} AS own FROM r)
SELECT cand_id, category, false AS filled FROM c WHERE own UNION ALL SELECT cand_id, category, true FROM (SELECT * FROM c WHERE NOT own ORDER BY conf_pct DESC, cand_id LIMIT {100 - sum(_QUOTAS.values())}) f""")
def w05(s: Source) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("parser", "validator", "arithmetic", "memory", "unknown", "state_machine", "error_handler")])
    rows = s.b_candidates.withColumn("category", F.element_at(names, (F.col("cand_id") % 7 + 1).cast("int")))
    return select.by_quota(rows, _QUOTAS, 100, "conf_pct", "cand_id").select("cand_id", "category", "filled")


@query("t11_adaptive_quotas", f"""
WITH p AS ({PROFILE}), b(category, base, place) AS (VALUES {", ".join(f"('{c}', {v}e0, {i})" for i, (c, v) in enumerate(dims.QUOTA_SHARE.items()))}),
r AS (SELECT b.category, place, base * greatest(0.5e0, least(2e0, coalesce(share, 0e0) / greatest(base, 0.01e0))) AS raw FROM b LEFT JOIN p ON p.category = b.category),
s AS (SELECT category, place, greatest(1, CAST(floor(raw / (SELECT sum(raw) FROM r) * 75) AS BIGINT)) AS slots FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY slots DESC, place) AS n FROM s)
SELECT category, CAST(slots + CASE WHEN n <= 75 - (SELECT sum(slots) FROM s) THEN 1 ELSE 0 END AS BIGINT) AS slots FROM o""")
def t11(s: Source) -> DataFrame:
    # The profile of the program's calls, at most one row a category.
    shares = {r.category: r.share for r in select.profile(s.b_ops.filter("callee IS NOT NULL"), "callee").collect()}
    return s.spark.createDataFrame(list(select.adaptive_quotas(shares, 75).items()), "category string, slots long")


@query("w06_elbow", """
WITH g AS (SELECT s, row_number() OVER (ORDER BY s DESC, p_partkey) - 1 AS i, s - lead(s) OVER (ORDER BY s DESC, p_partkey) AS gap FROM (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS s FROM part) t)
SELECT coalesce((SELECT arg_min(s, i) FROM g WHERE i >= 5 AND gap < 0.5 * (SELECT avg(gap) FROM g)), (SELECT s FROM g WHERE i = (SELECT count(*) FROM g) // 4)) AS threshold""")
def w06(s: Source) -> DataFrame:
    return select.elbow(s.part.select("p_partkey", F.floor("p_retailprice").alias("s")), "s")


@query("w12_ids_by_severity", f"SELECT cand_id, fn, vuln_type, format('VULN-{{:03d}}', row_number() OVER (ORDER BY CASE {_SEV} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END DESC, cand_id, fn, vuln_type)) AS id FROM b_candidates")
def w12(s: Source) -> DataFrame:
    rows = s.b_candidates.withColumn("severity", fuse.default_severity(F.col("vuln_type")))
    return report.numbered(rows, "cand_id", "fn", "vuln_type").select("cand_id", "fn", "vuln_type", "id")


@query("t01_rank", "SELECT fn, cand_id, vuln_type, CAST(row_number() OVER (PARTITION BY fn ORDER BY conf_pct < 10, conf_pct DESC, cand_id, vuln_type, match_kind) AS INTEGER) AS place FROM b_candidates")
def t01(s: Source) -> DataFrame:
    order = Window.partitionBy("fn").orderBy(F.col("conf_pct") < 10, F.desc("conf_pct"), "cand_id", "vuln_type", "match_kind")
    return s.b_candidates.select("fn", "cand_id", "vuln_type", F.row_number().over(order).alias("place"))


@query("t04_library_first", "SELECT cand_id FROM b_candidates ORDER BY match_kind <> 'LIBRARY_MATCH', conf_pct DESC, cand_id LIMIT 50")
def t04(s: Source) -> DataFrame:
    return select.library_first(s.b_candidates, 50).select("cand_id")


@query("t06_two_tier_screening", """
SELECT fn, score, n FROM (SELECT f.fn, f.score, coalesce(c.n, 0) AS n FROM (SELECT concat('fn_', CAST(s_suppkey AS VARCHAR)) AS fn, (s_suppkey % 10) / 10 AS score FROM supplier) f
  LEFT JOIN (SELECT fn, count(*) AS n FROM b_candidates WHERE conf_pct > 98 GROUP BY fn) c ON c.fn = f.fn) t WHERE score >= 0.3 ORDER BY n > 0, score DESC, fn LIMIT 15""")
def t06(s: Source) -> DataFrame:
    f = s.supplier.select(F.concat(F.lit("fn_"), F.col("s_suppkey").cast("string")).alias("fn"), (F.col("s_suppkey") % 10 / 10).alias("score"))
    return select.screening(f, s.b_candidates.filter("conf_pct > 98").groupBy("fn").agg(F.count("*").alias("n")), 15, 0.3).select("fn", "score", "n")


@query("t08_cap_confirmed", "SELECT cand_id FROM b_candidates WHERE conf_pct > 50 ORDER BY conf_pct DESC, cand_id LIMIT 500")
def t08(s: Source) -> DataFrame:
    return select.capped(s.b_candidates.filter("conf_pct > 50")).select("cand_id")


@query("u01_union_extras", "SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 70 = 0")
def u01(s: Source) -> DataFrame:
    own = s.customer.select("c_custkey", "c_acctbal")
    return select.with_extras(own.filter("c_custkey % 50 = 0"), own.filter("c_custkey % 70 = 0"), "c_custkey", "c_acctbal").select("c_custkey")


@query("u02_difference", "SELECT fn FROM b_ops EXCEPT SELECT fn FROM b_ops WHERE op = 'CALLIND'")
def u02(s: Source) -> DataFrame:
    return s.b_ops.select("fn").distinct().exceptAll(s.b_ops.filter("op = 'CALLIND'").select("fn").distinct())


@query("u05_ground_truth_sets", """
WITH t AS (SELECT DISTINCT doc_id FROM b_truth WHERE label = 1), p AS (SELECT DISTINCT doc_id FROM b_truth WHERE predicted = 1)
SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM p) a) AS hit, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p) b) AS missed, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t) c) AS extra""")
def u05(s: Source) -> DataFrame:
    return select.both_sides(s.b_truth.filter("label = 1"), s.b_truth.filter("predicted = 1"), "doc_id")


@query("u07_append_uncovered", "SELECT fn, vuln_type FROM b_candidates WHERE conf_pct > 90 UNION ALL SELECT fn, 'format_string' FROM (SELECT DISTINCT fn FROM b_candidates) f WHERE fn NOT IN (SELECT fn FROM b_candidates WHERE conf_pct > 90 AND vuln_type = 'format_string')")
def u07(s: Source) -> DataFrame:
    sem = s.b_candidates.select("fn").distinct().select("fn", F.lit("format_string").alias("vuln_type"), F.array(F.lit("a"), F.lit("b")).alias("items"))
    return evidence.append_uncovered(s.b_candidates.filter("conf_pct > 90").select("fn", "vuln_type"), sem)


@query("a11_score_bins", "SELECT CAST(least(conf_pct // 20, 4) AS INTEGER) AS bin, count(*) AS n FROM b_candidates GROUP BY 1")
def a11(s: Source) -> DataFrame:
    return metrics.score_bins(s.b_candidates)


@query("a13_cost_rollup", "SELECT coalesce(stage, 'TOTAL') AS stage, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / 1000.0 * 0.25, 6)::DOUBLE AS cost FROM b_calls GROUP BY ROLLUP (stage)")
def a13(s: Source) -> DataFrame:
    return metrics.cost_by_stage(s.b_calls, 0.25)


@query("p39_token_estimate", "SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations")
def p39(s: Source) -> DataFrame:
    return s.conversations.select("conv_id", "turn", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))


_CONF = "count_if(label = 1 AND predicted = 1) AS tp, count_if(label <> 1 AND predicted = 1) AS fp, count_if(label = 1 AND predicted <> 1) AS fn, count_if(label <> 1 AND predicted <> 1) AS tn"


@query("a14_confusion", f"WITH c AS (SELECT {_CONF} FROM b_truth) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 3) AS f1 FROM c")
def a14(s: Source) -> DataFrame:
    return metrics.confusion(s.b_truth)


@query("a16_outcomes", "SELECT support, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM b_assess GROUP BY support")
def a16(s: Source) -> DataFrame:
    return metrics.outcomes(s.b_assess, "support")


@query("a17_graph_stats", "SELECT count(*) AS edges, count(DISTINCT caller) AS callers, count(DISTINCT callee) AS callees FROM b_graph")
def a17(s: Source) -> DataFrame:
    return metrics.graph_stats(s.b_graph)


@query("a17b_stored_stats", "SELECT coalesce(match_kind, 'TOTAL') AS role, count(*) AS n, count(DISTINCT fn) AS keys FROM b_candidates GROUP BY ROLLUP (match_kind)")
def a17b(s: Source) -> DataFrame:
    return metrics.stored_stats(s.b_candidates, "fn", "match_kind")


@query("k17_cost_table", """
WITH c AS (SELECT coalesce(stage, 'TOTAL') AS stage, CAST(count(*) AS VARCHAR) AS calls, CAST(sum(tokens) AS VARCHAR) AS tokens FROM b_calls GROUP BY ROLLUP (stage)),
w AS (SELECT greatest(5, max(length(stage))) AS a, greatest(5, max(length(calls))) AS b, greatest(6, max(length(tokens))) AS d FROM c)
SELECT CAST(0 AS BIGINT) AS line_no, rtrim(rpad('stage', CAST(a AS INTEGER), ' ') || '  ' || rpad('calls', CAST(b AS INTEGER), ' ') || '  ' || rpad('tokens', CAST(d AS INTEGER), ' ')) AS line FROM w
UNION ALL SELECT row_number() OVER (ORDER BY stage = 'TOTAL', stage), rtrim(rpad(stage, CAST(a AS INTEGER), ' ') || '  ' || rpad(calls, CAST(b AS INTEGER), ' ') || '  ' || rpad(tokens, CAST(d AS INTEGER), ' ')) FROM c, w""")
def k17(s: Source) -> DataFrame:
    return report.table(metrics.cost_by_stage(s.b_calls, 0.5), ["stage", "calls", "tokens"], F.col("stage") == "TOTAL", F.col("stage"))


@query("k17b_regression_table", """
WITH g AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'c' END AS part, label, predicted FROM b_truth)
SELECT coalesce(part, 'TOTAL') AS part, count_if(label = 1 AND predicted = 1) AS tp, count_if(label <> 1 AND predicted = 1) AS fp, count_if(label = 1 AND predicted <> 1) AS fn, count_if(label <> 1 AND predicted <> 1) AS tn FROM g GROUP BY ROLLUP (part)""")
def k17b(s: Source) -> DataFrame:
    part = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise("c")
    return metrics.confusion_with_total(s.b_truth.withColumn("part", part), "part").select("part", "tp", "fp", "fn", "tn")


@query("a22_stage_reduction", "SELECT fn, n, k, round(coalesce((n - k) * 100 / nullif(n, 0), 0.0), 1)::DOUBLE AS reduction FROM (SELECT fn, count(*) AS n, count_if(conf_pct > 60) AS k FROM b_candidates GROUP BY fn) t")
def a22(s: Source) -> DataFrame:
    g = s.b_candidates.groupBy("fn").agg(F.count("*").alias("n"), F.count_if(F.col("conf_pct") > 60).alias("k"))
    return g.select("fn", "n", "k", metrics.reduction(F.col("n"), F.col("k")).alias("reduction"))


@query("e02_semantic_risk", """
WITH l AS (SELECT *, lag(op) OVER (PARTITION BY fn ORDER BY seq) AS prev FROM b_ops),
c AS (SELECT fn, count_if(op = 'INT_MULT') AS m, count_if(op IN ('INT_ADD', 'INT_MULT')) AS a, count_if(op = 'STORE') AS st, count_if(op = 'CBRANCH') AS b, count_if(coalesce(contains(lower(callee), 'alloc'), false)) AS al, count_if(op = 'STORE' AND prev IN ('INT_ADD', 'INT_SUB', 'INT_MULT', 'PTRADD', 'PTRSUB')) AS x FROM l GROUP BY fn),
n AS (SELECT fn, CAST(al > 0 AS INT) + CAST(m >= 1 AS INT) + CAST(a >= 2 AS INT) + CAST(al > 0 AS INT) + CAST(b = 0 AND al > 0 AS INT) + CAST(x > 0 AS INT) AS na, CAST(st >= 3 AS INT) + CAST(a >= 2 AS INT) + CAST(b = 0 AND st >= 3 AS INT) AS nb FROM c)
SELECT fn, 'integer_overflow' AS vuln_type, na AS n FROM n WHERE na >= 2 UNION ALL SELECT fn, 'buffer_overflow', nb FROM n WHERE nb >= 2 AND na < 2""")
def e02(s: Source) -> DataFrame:
    o = ops.of_bridge(s.b_ops)
    arith = o.groupBy("fn").agg(F.count_if(F.col("op").isin("INT_ADD", "INT_MULT")).alias("arith"))
    return evidence.semantic_risk(ops.risk_counters(o).join(arith, "fn").withColumn("role", F.lit("unknown"))).select("fn", "vuln_type", F.size("items").alias("n"))


@query("e07_uncertainty", "SELECT cand_id, CAST(cand_id % 2 = 0 AS INT) + CAST(cand_id % 3 = 0 AS INT) + CAST(cand_id % 5 = 0 AS INT) >= 2 AS is_high FROM b_candidates")
def e07(s: Source) -> DataFrame:
    k = F.col("cand_id")
    return s.b_candidates.select("cand_id", evidence.is_uncertain(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("is_high"))


@query("e08_contradictions", "SELECT cand_id, concat_ws(',', CASE WHEN conf_pct < 50 AND cand_id % 4 >= 2 THEN 'semantic_without_taint' END, CASE WHEN match_kind = 'NO_MATCH' AND cand_id % 2 = 0 THEN 'backward_source_only' END, CASE WHEN cand_id % 3 = 0 AND cand_id % 5 = 0 THEN 'check_beside_multiplication' END) AS found FROM b_candidates")
def e08(s: Source) -> DataFrame:
    k = F.col("cand_id")
    found = evidence.contradictions(F.col("conf_pct") >= 50, k % 4, F.col("match_kind") == "NO_MATCH", k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return s.b_candidates.select("cand_id", F.array_join(found, ",").alias("found"))


@query("e05_needs_slice", "SELECT cand_id, conf_pct < 30 AND cand_id % 3 <> 0 AS needed FROM b_candidates")
def e05(s: Source) -> DataFrame:
    path = F.array(F.when(F.col("conf_pct") < 30, 0.0).otherwise(0.5), F.when(F.col("cand_id") % 3 == 0, 0.9).otherwise(0.0))
    return s.b_candidates.select("cand_id", evidence.needs_slice(path).alias("needed"))


@query("s16_text_report", f"""
WITH c AS (SELECT *, {_SEV} AS sev FROM b_candidates), y AS (SELECT * FROM c WHERE conf_pct > 80), n AS (SELECT * FROM c WHERE NOT conf_pct > 80), f AS (SELECT fn, count(*) AS candidates, count_if(match_kind = 'NO_MATCH') AS unknown_calls FROM c GROUP BY fn)
SELECT 1 AS section, CAST(1 AS BIGINT) AS line_no, 'Functions: ' || (SELECT count(*) FROM f) AS line UNION ALL SELECT 1, 2, 'Candidates: ' || (SELECT count(*) FROM c) UNION ALL SELECT 1, 3, 'Confirmed: ' || (SELECT count(*) FROM y) UNION ALL SELECT 1, 4, 'Rejected: ' || (SELECT count(*) FROM n)
UNION ALL SELECT 2, row_number() OVER (ORDER BY CASE sev WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END DESC, cand_id, fn, vuln_type, match_kind), '[' || upper(sev) || '] ' || vuln_type || ' in ' || fn || ' at ' || sink_fn || ' (' || CAST(conf_pct AS VARCHAR) || '%)' FROM y
UNION ALL SELECT 3, row_number() OVER (ORDER BY cand_id, fn, vuln_type, match_kind), vuln_type || ' in ' || fn || ' at ' || sink_fn || ': ' || lower(match_kind) FROM n
UNION ALL SELECT 4, row_number() OVER (ORDER BY candidates DESC, fn), fn || ' vulns=' || candidates || ' unknown_calls=' || unknown_calls FROM f""")
def s16(s: Source) -> DataFrame:
    rows = s.b_candidates.withColumns({"severity": fuse.default_severity(F.col("vuln_type")), "reason": F.lower("match_kind")})
    stats = rows.groupBy("fn").agg(F.count("*").alias("candidates"), F.count_if(F.col("match_kind") == "NO_MATCH").alias("unknown_calls"))
    return report.text_report(rows.filter("conf_pct > 80"), rows.filter("NOT conf_pct > 80"), stats, "cand_id", "fn", "vuln_type", "match_kind")


@query("s17b_html_rows", f"""
WITH c AS (SELECT *, {_SEV} AS sev FROM b_candidates WHERE conf_pct > 80), o AS (SELECT *, row_number() OVER (ORDER BY CASE sev WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END DESC, cand_id, fn, vuln_type) AS line_no FROM c)
SELECT line_no, '<tr class=' || chr(39) || sev || chr(39) || '><td>' || format('VULN-{{:03d}}', line_no) || '</td><td>' || sev || '</td><td>' || vuln_type || '</td><td>' || fn || '</td><td>' || sink_fn || '</td><td>' || conf_pct || '</td><td></td></tr>' AS html FROM o""")
def s17b(s: Source) -> DataFrame:
    rows = s.placed("b_candidates").withColumn("severity", fuse.default_severity(F.col("vuln_type")))
    return report.html_lines(rows.filter("conf_pct > 80"), rows.filter("NOT conf_pct > 80"), "program", "cand_id", "fn", "vuln_type", "place").filter("section = 2").select("line_no", "html")


@query("s18_json_report", f"""
SELECT id, severity, vuln_type, fn FROM (SELECT format('VULN-{{:03d}}', row_number() OVER (ORDER BY CASE {_SEV} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END DESC, cand_id, fn, vuln_type)) AS id, {_SEV} AS severity, vuln_type, fn FROM b_candidates) t""")
def s18(s: Source) -> DataFrame:
    rows = s.b_candidates.withColumn("severity", fuse.default_severity(F.col("vuln_type")))
    j = report.json_findings(rows, "cand_id", "fn", "vuln_type")
    return j.select(F.from_json("finding", "id string, severity string, vuln_type string, fn string").alias("f")).select("f.*")
