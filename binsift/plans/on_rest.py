"""Queries over the remaining operators: canonical names, store gates, single scores, routes, service contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.names import contains_any
from ..operators import evidence, fuse, match, ops, select, services, sources, store, taint
from ..sources import external, tables
from . import taint_sql
from .base import Source, query
from .on_more import _R, _SCORES, _score_inputs


@query("p01_canonical_operands", """
WITH u AS (SELECT fn, seq, 0 AS slot, in1 AS var, seq * 10 AS pos FROM b_ops UNION ALL SELECT fn, seq, 1, in2, seq * 10 + 1 FROM b_ops UNION ALL SELECT fn, seq, -1, out_var, seq * 10 + 5 FROM b_ops WHERE out_var IS NOT NULL),
n AS (SELECT fn, var, row_number() OVER (PARTITION BY fn ORDER BY min(pos), var) - 1 AS k FROM u WHERE NOT starts_with(var, 'const') GROUP BY fn, var)
SELECT u.fn, u.seq, CAST(u.slot AS INTEGER) AS slot, CASE WHEN n.k IS NOT NULL THEN 'VAR_' || CAST(n.k AS VARCHAR) ELSE 'const(0x' || lower(to_hex(CAST(regexp_extract(u.var, '([0-9]+)', 1) AS BIGINT))) || ')' END AS name FROM u LEFT JOIN n ON n.fn = u.fn AND n.var = u.var""")
def p01(s: Source) -> DataFrame:
    return ops.canonical(ops.of_bridge(s.b_ops))


@query("p24_source_confidence", """
SELECT DISTINCT callee, CASE callee WHEN 'recv' THEN 'DIRECT_IO' WHEN 'fread' THEN 'DIRECT_IO' WHEN 'recvmsg' THEN 'DIRECT_IO' WHEN 'fgets' THEN 'DIRECT_IO' WHEN 'scanf' THEN 'DIRECT_IO' WHEN 'getenv' THEN 'ENVIRONMENT'
  WHEN 'my_read_buffer' THEN 'LIBRARY_READER' WHEN 'png_read_row' THEN 'LIBRARY_READER' WHEN 'memcpy' THEN NULL WHEN 'malloc' THEN NULL WHEN 'calloc' THEN NULL WHEN 'realloc' THEN NULL WHEN 'free' THEN NULL WHEN 'strlen' THEN NULL WHEN 'printf' THEN NULL ELSE 'UNKNOWN' END AS role,
  CASE callee WHEN 'recv' THEN 1e0 WHEN 'fread' THEN 1e0 WHEN 'recvmsg' THEN 1e0 WHEN 'fgets' THEN 1e0 WHEN 'scanf' THEN 1e0 WHEN 'getenv' THEN 0.65e0 WHEN 'my_read_buffer' THEN 0.9e0 WHEN 'png_read_row' THEN 0.9e0 ELSE 0e0 END AS conf FROM b_prog WHERE callee IS NOT NULL""")
def p24(s: Source) -> DataFrame:
    named = s.b_prog.filter("callee IS NOT NULL").select("callee").distinct().withColumn("role", sources.source_role(F.col("callee")))
    return named.withColumn("conf", sources.base_confidence(F.col("role")))


@query("p30_severity_boost", "SELECT cand_id, vuln_type, CASE vuln_type WHEN 'integer_overflow' THEN 'high' WHEN 'write_what_where' THEN 'critical' ELSE 'critical' END AS boosted FROM b_candidates")
def p30(s: Source) -> DataFrame:
    return s.b_candidates.select("cand_id", "vuln_type", select.boosted(fuse.default_severity(F.col("vuln_type"))).alias("boosted"))


@query("j03_learned_rules", "SELECT fn, seq, callee, CASE callee WHEN 'xmlStrlen' THEN 'validator' WHEN 'malloc' THEN 'allocator' END AS role FROM b_ops WHERE op = 'CALL' AND callee IS NOT NULL")
def j03(s: Source) -> DataFrame:
    learned = s.spark.createDataFrame([("xmlStrlen", "validator"), ("malloc", "allocator"), ("recv", "logger")], "rule_fn string, role string")
    kept = learned.filter(F.col("role").isin("allocator", "copy", "read_input", "exec", "validator"))
    calls = match.calls(ops.of_bridge(s.b_ops))
    return calls.join(kept, calls["callee"] == kept["rule_fn"], "left").select("fn", "seq", "callee", "role")


@query("k02_learned_summaries", "SELECT fn, arg_max(conf_pct, sem_id) AS conf_pct, max(sem_id) AS sem_id FROM b_sem GROUP BY fn")
def k02(s: Source) -> DataFrame:
    rows = s.b_sem.select("fn", "sem_id", "conf_pct")
    return store.latest(rows.filter("conf_pct < 50"), rows.filter("conf_pct >= 50"), ["fn"], "sem_id")


_KNOWN = ["malloc", "free", "memcpy", "fread", "recv", "read", "strcpy", "system"]


@query("k06_store_fingerprints", "SELECT skey, count(*) AS seen_count, min(fn) AS fn FROM (SELECT fn, sha256(string_agg(op, ' ' ORDER BY seq))[1:16] AS skey FROM b_ops GROUP BY fn UNION ALL SELECT fn, sha256(string_agg(op, ' ' ORDER BY seq))[1:16] FROM b_ops GROUP BY fn) t GROUP BY skey")
def k06(s: Source) -> DataFrame:
    keys = ops.ordered_hash(s.b_ops, F.col("op"), "skey")
    once = keys.groupBy("skey").agg(F.count("*").alias("seen_count"), F.min("fn").alias("fn"))
    return store.merged(once, once, ["skey"])


@query("k08_reject_and_list", "SELECT fn, vuln_type, sink_fn, count(*) AS seen_count FROM b_candidates WHERE conf_pct < 20 GROUP BY 1, 2, 3 ORDER BY seen_count DESC, fn, vuln_type, sink_fn LIMIT 50")
def k08(s: Source) -> DataFrame:
    return store.counted(s.b_candidates.filter("conf_pct < 20"), ["fn", "vuln_type", "sink_fn"], "cand_id").orderBy(F.desc("seen_count"), "fn", "vuln_type", "sink_fn").limit(50)


@query("k09_review_gates", """
WITH s AS (SELECT DISTINCT fn, vuln_type FROM b_candidates WHERE conf_pct = 2), k AS (SELECT * FROM b_candidates c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.fn = c.fn AND s.vuln_type = c.vuln_type))
SELECT cand_id, vuln_type, match_kind = 'LIBRARY_MATCH' AND NOT contains(lower(sink_fn), 'alloc') AS auto FROM k""")
def k09(s: Source) -> DataFrame:
    kept = select.without_suppressed(s.b_candidates, s.b_candidates.filter("conf_pct = 2"))
    return kept.select("cand_id", "vuln_type", ((F.col("match_kind") == "LIBRARY_MATCH") & ~contains_any(F.lower("sink_fn"), ["alloc"])).alias("auto"))


@query("k13_evidence_items", "SELECT cand_id, CAST(CAST(cand_id % 2 = 0 AS INT) + CAST(cand_id % 3 = 0 AS INT) AS INTEGER) AS n, cand_id % 3 = 0 AS has_second FROM b_candidates")
def k13(s: Source) -> DataFrame:
    items = F.array_compact(F.array(F.when(F.col("cand_id") % 2 == 0, F.lit("a")), F.when(F.col("cand_id") % 3 == 0, F.lit("b"))))
    return s.b_candidates.select("cand_id", F.size(items).alias("n"), F.array_contains(items, "b").alias("has_second"))


@query("k16_ranked_names", "SELECT DISTINCT coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type) AS name FROM part")
def k16(s: Source) -> DataFrame:
    k = F.col("p_partkey")
    return s.part.select(F.coalesce(F.when(k % 2 == 0, F.col("p_name")), F.when(k % 3 == 0, F.col("p_brand")), F.col("p_type")).alias("name")).distinct()


@query("k19_context_block", "SELECT fn, string_agg(DISTINCT callee, ', ' ORDER BY callee) FILTER (WHERE callee IN ('malloc', 'free', 'memcpy', 'fread', 'recv', 'strcpy', 'system')) AS known FROM b_ops GROUP BY fn")
def k19(s: Source) -> DataFrame:
    hit = F.when(F.col("callee").isin("malloc", "free", "memcpy", "fread", "recv", "strcpy", "system"), F.col("callee"))
    g = s.b_ops.groupBy("fn").agg(F.array_sort(F.collect_set(hit)).alias("k"))
    return g.select("fn", F.when(F.size("k") > 0, F.array_join("k", ", ")).alias("known"))


@query("k20_answer_fields", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 16 AS k FROM events")
def k20(s: Source) -> DataFrame:
    answer = F.concat(F.lit("```\n"), F.col("props"), F.lit("```"))
    return s.events.select("event_id", (external.parsed(answer, "k int")["k"] % 16).alias("k"))


for _name in evidence.SCORE_WEIGHTS:

    def _one(s: Source, name: str = _name) -> DataFrame:
        return evidence.scores(_score_inputs(s)).select("fn", F.col(name).alias("score"))

    _number = {"exposure": 1, "arithmetic": 2, "validation": 3, "graph": 4, "semantic": 5, "pattern_store": 6, "memory": 7, "dangerous_calls": 8}[_name]
    query(f"r0{_number}_{_name}_score", f"SELECT fn, {_name} AS score FROM (SELECT k AS fn, {_SCORES} FROM ({_R}) r) t")(_one)


@query("e03_risk_by_role", """
WITH c AS (SELECT fn, count_if(op = 'INT_MULT') AS m, count_if(op IN ('INT_ADD', 'INT_MULT')) AS a, count_if(op = 'STORE') AS st, count_if(op = 'CBRANCH') AS b, count_if(coalesce(contains(lower(callee), 'alloc'), false)) AS al, count_if(x) AS x, CAST(split_part(fn, '_', 2) AS INT) % 3 AS r
  FROM (SELECT *, op = 'STORE' AND coalesce(lag(op) OVER (PARTITION BY fn ORDER BY seq) IN ('INT_ADD', 'INT_MULT', 'PTRADD', 'PTRSUB'), false) AS x FROM b_ops) o GROUP BY fn),
n AS (SELECT fn, CAST(r = 0 OR r = 2 AND al > 0 AS INT) + CAST(m >= 1 AS INT) + CAST(a >= 2 AS INT) + CAST(al > 0 AS INT) + CAST(b = 0 AND al > 0 AS INT) + CAST(x > 0 AS INT) AS na, CAST(r = 0 AS INT) + CAST(st >= 3 AS INT) + CAST(a >= 2 AS INT) + CAST(b = 0 AND st >= 3 AS INT) AS nb,
  CASE WHEN r = 1 THEN 1 + CAST(b < 2 AS INT) + CAST(al > 0 OR st >= 2 AS INT) ELSE 0 END AS nv FROM c)
SELECT fn, 'integer_overflow' AS vuln_type, na AS n FROM n WHERE na >= 2 UNION ALL SELECT fn, 'buffer_overflow', nb FROM n WHERE nb >= 2 AND na < 2 UNION ALL SELECT fn, 'validator_bypass', nv FROM n WHERE nv >= 2""")
def e03(s: Source) -> DataFrame:
    o = ops.of_bridge(s.b_ops)
    arith = o.groupBy("fn").agg(F.count_if(F.col("op").isin("INT_ADD", "INT_MULT")).alias("arith"))
    r = F.substring_index("fn", "_", -1).cast("int") % 3
    return evidence.semantic_risk(ops.risk_counters(o).join(arith, "fn").withColumn("role", F.when(r == 0, "parser").when(r == 1, "validator").otherwise("unknown"))).select("fn", "vuln_type", F.size("items").alias("n"))


@query("f09_routing", "SELECT cand_id, vuln_type, CASE WHEN cand_id % 2 = 0 AND abs(conf_pct / 100 - 0.5) > 0.35 THEN 'needs_consensus' WHEN conf_pct / 100 >= 0.55 THEN 'bayes_direct_confirm' ELSE 'bayes_direct_reject' END AS route FROM b_candidates")
def f09(s: Source) -> DataFrame:
    c = F.col("conf_pct") / 100
    return s.b_candidates.select("cand_id", "vuln_type", fuse.routing(c, F.lit(0.5), c, F.col("cand_id") % 2 == 0).alias("route"))


@query("f11_direct_verdicts", """
WITH s AS (SELECT DISTINCT fn FROM b_sem WHERE conf_pct >= 90)
SELECT a.fn, assess_id, support = 'Strong' AS confirmed, CASE WHEN s.fn IS NOT NULL THEN 'high' ELSE 'medium' END AS severity FROM b_assess a LEFT JOIN s ON s.fn = a.fn WHERE support <> 'Weak'""")
def f11(s: Source) -> DataFrame:
    route = F.when(F.col("support") == "Weak", "needs_consensus").when(F.col("support") == "Strong", "bayes_direct_confirm").otherwise("bayes_direct_reject")
    fused = s.b_assess.select("fn", "assess_id", F.lit(0.5).alias("posterior"), route.alias("routing"), F.lit("medium").alias("severity"))
    return fuse.direct_verdicts(fused, s.b_sem.filter("conf_pct >= 90")).drop("posterior")


@query("f13_fast_paths", "SELECT cand_id, vuln_type, round(CASE cand_id % 4 WHEN 0 THEN least(1.0, c * 1.1) WHEN 1 THEN 0.2 WHEN 2 THEN c * 0.9 ELSE c * 0.8 END, 6)::DOUBLE AS confidence FROM (SELECT *, conf_pct / 100 AS c FROM b_candidates) t")
def f13(s: Source) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("agrees_vulnerable", "agrees_safe", "one_sided_memory", "disagrees")]), (F.col("cand_id") % 4 + 1).cast("int"))
    return s.b_candidates.select("cand_id", "vuln_type", F.round(fuse.verdict_confidence(kind, F.col("conf_pct") / 100), 6).alias("confidence"))


@query("x09_tainted_sizes", f"SELECT vuln_type, sink_fn, match_kind, count(*) AS n FROM ({taint_sql.CANDIDATES}) c GROUP BY vuln_type, sink_fn, match_kind")
def x09(s: Source) -> DataFrame:
    """Candidates of the walk by rule family: what each sink and type was told by."""
    return taint.candidates(taint.analyze(ops.of_programs(s.b_prog), whole=True)).groupBy("vuln_type", "sink_fn", "match_kind").agg(F.count("*").alias("n"))


@query("l01_callee_names", "SELECT DISTINCT '0x' || lower(to_hex(k)) AS target, CASE WHEN k % 3 = 0 THEN 'name_' || CAST(k AS VARCHAR) END AS name FROM b_ops WHERE op = 'CALLIND'")
def l01(s: Source) -> DataFrame:
    hexed = F.concat(F.lit("0x"), F.lower(F.hex("k")))
    k = F.conv(F.substring("target", 3, 20), 16, 10).cast("int")
    name = F.when(k % 3 == 0, F.concat(F.lit("name_"), k.cast("string"))).when(k % 3 == 1, F.col("target")).otherwise(F.lit(" "))
    return services.callee_names(s.b_ops.filter("op = 'CALLIND'").select(hexed.alias("target")), lambda q: q.withColumn("name", name))


@query("l02_verified_summaries", """
WITH g AS (SELECT fn, bool_or(coalesce(callee IN ('system'), false)) AS ce, bool_or(op = 'LOAD') AS l, bool_or(op = 'STORE') AS st, CAST(split_part(fn, '_', 2) AS INT) AS k FROM b_ops GROUP BY fn)
SELECT fn, CASE k % 3 WHEN 0 THEN 'copy' ELSE 'exec' END AS likely_role, CASE WHEN k % 3 = 0 THEN 'weakly_confirmed' ELSE 'confirmed' END AS status, CASE WHEN k % 3 = 0 THEN 0.42e0 ELSE 0.7e0 END AS confidence
FROM g WHERE (k % 3 = 0 AND l AND st OR k % 3 = 1 AND ce) AND k % 7 <> 0
UNION ALL SELECT fn, 'exec', 'confirmed', 0.9e0 FROM g WHERE k % 7 = 0 AND ce""")
def l02(s: Source) -> DataFrame:
    signs = evidence.role_signs(ops.of_bridge(s.b_ops))
    k = F.substring_index("fn", "_", -1).cast("int")
    empty = external.ask("summaries", signs.select("fn"))
    cache = empty.unionByName(signs.filter(k % 7 == 0).select("fn", F.lit("exec").alias("likely_role"), F.lit(0.9).alias("confidence")), allowMissingColumns=True)
    service = lambda q: q.select("fn", F.when(k % 3 == 0, "copy").when(k % 3 == 1, "exec").alias("likely_role"), F.lit(0.7).alias("confidence"))
    return services.summaries(signs, cache, signs, service)[0].select("fn", "likely_role", "status", "confidence")


@query("l03_reviewed_candidates", """
WITH b AS (SELECT cand_id, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY conf_pct DESC, cand_id) AS n FROM b_candidates WHERE conf_pct >= 50) t WHERE n <= 4 ORDER BY conf_pct DESC, cand_id LIMIT 40)
SELECT cand_id, cand_id % 2 = 0 AS confirmed FROM b WHERE cand_id % 5 <> 0""")
def l03(s: Source) -> DataFrame:
    service = lambda q: q.select("cand_id", (F.col("cand_id") % 2 == 0).alias("confirmed"), F.when(F.col("cand_id") % 5 == 0, 0.3).otherwise(0.8).alias("confidence"))
    return services.reviewed(s.b_candidates, service).select("cand_id", "confirmed")


@query("l04_assessed_candidates", """
WITH b AS (SELECT cand_id, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY conf_pct DESC, cand_id) AS n FROM b_candidates WHERE conf_pct >= 35) t WHERE n <= 4 ORDER BY conf_pct DESC, cand_id LIMIT 40)
SELECT cand_id, CASE WHEN cand_id % 2 = 0 THEN 'Strong' ELSE 'Weak' END AS support FROM b WHERE cand_id % 3 <> 0""")
def l04(s: Source) -> DataFrame:
    service = lambda q: q.filter("cand_id % 3 <> 0").select("cand_id", F.when(F.col("cand_id") % 2 == 0, "Strong").otherwise("Weak").alias("support"))
    return services.assessed(s.b_candidates, service).select("cand_id", "support")


@query("l05_chained_analyses", """
WITH f AS (SELECT DISTINCT fn, CAST(split_part(fn, '_', 2) AS INT) AS k FROM b_ops), a(name, i) AS (VALUES ('arithmetic', 0), ('bounds', 1), ('lifetime', 2), ('control_flow', 3), ('interface', 4))
SELECT fn, name AS analysis_type, round((k % 10 + i * 2) / 20.0, 6)::DOUBLE AS confidence FROM f, a WHERE (k % 10 + i * 2) / 20.0 >= 0.4""")
def l05(s: Source) -> DataFrame:
    k = F.substring_index("fn", "_", -1).cast("int")
    service = lambda q: q.select("fn", "analysis_type", F.lit("x").alias("vuln_type"), F.round((k % 10 + F.size("seen") * 2) / 20, 6).alias("confidence"))
    return services.chained(s.b_ops.select("fn").distinct(), service).select("fn", "analysis_type", "confidence")


@query("l06_logic_screening", """
SELECT fn FROM (SELECT f.fn, f.score, coalesce(c.n, 0) AS n FROM (SELECT concat('fn_', CAST(s_suppkey AS VARCHAR)) AS fn, (s_suppkey % 10) / 10 AS score FROM supplier) f
  LEFT JOIN (SELECT fn, count(*) AS n FROM b_candidates WHERE conf_pct > 98 GROUP BY fn) c ON c.fn = f.fn WHERE score >= 0.3 ORDER BY n > 0, score DESC, fn LIMIT 15) t WHERE score >= 0.8""")
def l06(s: Source) -> DataFrame:
    f = s.supplier.select(F.concat(F.lit("fn_"), F.col("s_suppkey").cast("string")).alias("fn"), (F.col("s_suppkey") % 10 / 10).alias("score"))
    counts = s.b_candidates.filter("conf_pct > 98").groupBy("fn").agg(F.count("*").alias("n"))
    return services.screened(f, counts, lambda q: q.select("fn", (F.col("score") >= 0.8).alias("found"))).select("fn")


@query("l07_arbitration", """
WITH k AS (SELECT cand_id, CASE cand_id % 5 WHEN 0 THEN 'disagrees' WHEN 1 THEN 'agrees_safe' WHEN 2 THEN 'agrees_vulnerable' WHEN 3 THEN 'one_sided_memory' ELSE 'disagrees' END AS kind, conf_pct / 100 AS c FROM b_candidates)
SELECT cand_id, kind, CASE WHEN cand_id % 5 = 0 THEN true ELSE kind NOT IN ('agrees_safe', 'disagrees') END AS confirmed,
  round(CASE WHEN cand_id % 5 = 0 THEN 0.9e0 WHEN kind = 'agrees_vulnerable' THEN least(1e0, c * 1.1) WHEN kind = 'agrees_safe' THEN 0.2e0 WHEN kind = 'one_sided_memory' THEN c * 0.9 ELSE c * 0.8 END, 6)::DOUBLE AS confidence FROM k""")
def l07(s: Source) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("disagrees", "agrees_safe", "agrees_vulnerable", "one_sided_memory", "disagrees"))), (F.col("cand_id") % 5 + 1).cast("int"))
    rows = s.b_candidates.select("cand_id", kinds.alias("kind"), (F.col("conf_pct") / 100).alias("confidence"))
    return services.arbitrated(rows, lambda q: q.filter("cand_id % 5 = 0").select("cand_id", F.lit(True).alias("confirmed"), F.lit(0.9).alias("confidence")).distinct())


@query("s11_metadata", "SELECT s_nationkey AS k, max(s_suppkey) AS newest FROM supplier GROUP BY s_nationkey HAVING s_nationkey = (SELECT min(s_nationkey) FROM supplier)")
def s11(s: Source) -> DataFrame:
    value = F.to_json(F.struct(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("newest")))
    rows = s.supplier.select(F.col("s_nationkey").cast("string").alias("key"), value.alias("value"), F.col("s_suppkey").alias("version"))
    kept = store.put_metadata(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"))
    first = s.supplier.agg(F.min("s_nationkey").cast("string").alias("n")).first().n
    return store.metadata(kept, first, "k bigint, newest bigint")


@query("t09_final_findings", "SELECT cand_id, fn, vuln_type, sink_fn, CAST(row_number() OVER (ORDER BY conf_pct DESC, cand_id, fn, vuln_type, sink_fn) AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY fn, vuln_type, sink_fn ORDER BY conf_pct DESC, cand_id) AS n FROM b_candidates) t WHERE n = 1")
def t09(s: Source) -> DataFrame:
    kept = select.keep_max(s.b_candidates, ["fn", "vuln_type", "sink_fn"], "conf_pct", "cand_id")
    return select.final_findings(kept, "conf_pct", "cand_id", "fn", "vuln_type", "sink_fn").select("cand_id", "fn", "vuln_type", "sink_fn", F.col("place").cast("long").alias("place"))


@query("k14_lookups", """
SELECT DISTINCT callee, callee IN ('malloc', 'calloc', 'realloc') AS allocator, CASE callee WHEN 'recv' THEN 1e0 WHEN 'fread' THEN 1e0 WHEN 'recvmsg' THEN 1e0 WHEN 'fgets' THEN 1e0 WHEN 'scanf' THEN 1e0 WHEN 'getenv' THEN 0.65e0 WHEN 'my_read_buffer' THEN 0.9e0 WHEN 'png_read_row' THEN 0.9e0 ELSE 0e0 END AS confidence
FROM b_prog WHERE callee IS NOT NULL""")
def k14(s: Source) -> DataFrame:
    names = s.b_prog.filter("callee IS NOT NULL").select("callee").distinct()
    return names.select("callee", sources.is_allocator(F.col("callee")).alias("allocator"), sources.confidence_of(F.col("callee")).alias("confidence"))


@query("k14b_calibrated_findings", "SELECT cand_id, fn, sink_fn, round(greatest(0.05e0, least(0.99e0, 0.4 * (conf_pct / 100.0)::DOUBLE + 0.25 * CASE match_kind WHEN 'LIBRARY_MATCH' THEN 1e0 WHEN 'STRUCTURAL_MATCH' THEN 0.7e0 ELSE 0.4e0 END * least(1e0, 5e0 / 8) * 0.8e0 + 0.2 * 0.5e0 + 0.1 * 0.3e0 + 0.05 * 0.5e0)), 6) AS calibrated FROM b_candidates")
def k14b(s: Source) -> DataFrame:
    rows = s.b_candidates.select("cand_id", "fn", "sink_fn", "match_kind", (F.col("conf_pct") / 100).alias("llm"), F.lit(5.0).alias("score"), F.lit(0.5).alias("taint"), F.lit("param:VAR_0").alias("source"), F.lit(True).alias("bounded"))
    return fuse.calibrated_finding(rows, "llm", "match_kind", "score", "taint", "source", "bounded").select("cand_id", "fn", "sink_fn", "calibrated")


@query("k21_learned_roles", "SELECT fn, arg_max(analysis_type, (conf_pct, analysis_type)) AS role FROM b_sem GROUP BY fn")
def k21(s: Source) -> DataFrame:
    rows = s.b_sem.select("fn", F.col("analysis_type").alias("role"), F.col("conf_pct").alias("confidence"))
    return store.learned_roles(rows)


@query("f14_fallback_verdicts", "SELECT cand_id, fn, sink_fn, conf_pct > 50 AS confirmed, round(conf_pct / 100.0::DOUBLE * 0.8e0, 6) AS confidence FROM b_candidates WHERE match_kind = 'NO_MATCH'")
def f14(s: Source) -> DataFrame:
    rows = s.b_candidates.filter("match_kind = 'NO_MATCH'").select("cand_id", "fn", "sink_fn", (F.col("conf_pct") > 50).alias("memory_confirmed"), (F.col("conf_pct") / 100).alias("confidence"))
    return fuse.fallback_verdicts(rows).drop("memory_confirmed")


@query("e04_validator_bypass", """
WITH c AS (SELECT fn, count_if(op = 'STORE') AS st, count_if(op = 'CBRANCH') AS b, count_if(coalesce(contains(lower(callee), 'alloc'), false)) AS al FROM b_ops GROUP BY fn)
SELECT fn, 'role' || CASE WHEN b < 2 THEN ',few_branches' ELSE '' END || CASE WHEN al > 0 OR st >= 2 THEN ',memory_writes' ELSE '' END AS items FROM c WHERE b < 2 OR al > 0 OR st >= 2""")
def e04(s: Source) -> DataFrame:
    o = ops.of_bridge(s.b_ops)
    counted = ops.risk_counters(o).join(o.groupBy("fn").agg(F.count_if(F.col("op").isin("INT_ADD", "INT_MULT")).alias("arith")), "fn").withColumn("role", F.lit("validator"))
    return evidence.semantic_risk(counted).filter("vuln_type = 'validator_bypass'").select("fn", F.array_join("items", ",").alias("items"))


@query("s05b_operations_by_table_function", """
SELECT fn, CAST(row_number() OVER (PARTITION BY fn ORDER BY seq) - 1 AS INTEGER) AS seq, op,
  CASE WHEN op = 'CALL' THEN callee WHEN op = 'CALLIND' THEN 'INDIRECT:' || in1 END AS callee, out_var, CASE WHEN op = 'CALLIND' THEN in2 ELSE in1 END AS first_arg
FROM b_ops WHERE op <> 'RETURN' OR seq % 2 = 0""")
def s05b(s: Source) -> DataFrame:
    # Records as JSON lines, one a function: every other RETURN stands as a bookkeeping operation, calls lead with their target.
    name = lambda c: F.struct(F.col(c).alias("name"), F.lit("unique").alias("space"), F.col("in_size").alias("size"))
    target = F.struct(F.concat(F.lit("<"), F.col("callee"), F.lit(">@plt")).alias("name"), F.lit("external").alias("space"), F.lit(8).alias("size"))
    op = F.when((F.col("op") == "RETURN") & (F.col("seq") % 2 == 1), "INDIRECT").otherwise(F.col("op"))
    inputs = F.when(F.col("op") == "CALL", F.array(target, name("in1"), name("in2"))).otherwise(F.array(name("in1"), name("in2")))
    row = F.struct("seq", op.alias("op"), F.struct(F.col("out_var").alias("name")).alias("output"), inputs.alias("inputs"))
    records = s.b_ops.groupBy(F.col("fn").alias("name")).agg(F.array_sort(F.collect_list(row)).alias("ops"))
    lines = records.select(F.lit("p.jsonl").alias("file"), F.lit(1).alias("n"), F.to_json(F.struct("name", "ops")).alias("line"))
    broken = records.select(F.lit("p.jsonl").alias("file"), F.lit(2).alias("n"), F.concat(F.lit('{"name": "'), F.col("name"), F.lit('", "ops": [')).alias("line"))
    return tables.operations(lines.unionByName(broken)).select("fn", "seq", "op", "callee", "out_var", F.get("args", 0).alias("first_arg"))
