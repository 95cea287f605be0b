"""Queries over call sites, rules and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, names
from ..operators import match, ops, patterns, select, sources
from .base import Source, query

_ROWS = [r for r in dims.rule_rows()]
_RULES = "(VALUES " + ", ".join(f"('{r[0]}', {r[7][0] if r[7] else -1}, {len(r[1])}, {r[2]}, {r[3]}, {r[4]}, {r[5]}, {r[6]}, {r[8]}, {r[10]}, '{r[11]}', {r[12]}, {r[13]}::DOUBLE, {r[14]}::DOUBLE)" for r in _ROWS) + ") AS r(rule_fn, size0, n_in, writes_at, all_ptr, reads_from, rt, bounded, frees_at, sink, sink_type, taint_arg, confidence, vuln_score)"
_SCORE = """CASE WHEN rule_fn IS NULL THEN 0.0 ELSE round((vuln_score + CASE WHEN sink THEN 10 + CASE sink_type WHEN 'command_injection' THEN 5 WHEN 'buffer_overflow' THEN 4 WHEN 'format_string' THEN 3 ELSE 0 END
 + CASE WHEN NOT bounded AND (writes_at >= 0 OR all_ptr) THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN n_in > 0 OR all_ptr THEN 3 ELSE 0 END + CASE WHEN rt THEN 2 ELSE 0 END) * confidence, 2) END"""
_M = f"(SELECT b.*, r.* FROM b_ops b LEFT JOIN {_RULES} ON r.rule_fn = b.callee WHERE b.op = 'CALL' AND b.callee IS NOT NULL) m"


def _calls(s: Source) -> DataFrame:
    return match.calls(ops.of_bridge(s.b_ops))


def _matched(s: Source) -> DataFrame:
    return match.library(_calls(s), dims.rules(s.spark))


@query("s08_rule_catalog", f"""
SELECT sink_type, count(*) AS n, count_if(sink) AS sinks, count_if(bounded) AS bounded, round(sum(vuln_score), 4) AS score, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls, count(calls) AS called
FROM (SELECT * FROM {_RULES}) r LEFT JOIN (SELECT callee, count(*) AS calls FROM b_ops WHERE callee IS NOT NULL GROUP BY callee) c ON c.callee = r.rule_fn GROUP BY sink_type""")
def s08(s: Source) -> DataFrame:
    calls = s.b_ops.filter("callee IS NOT NULL").groupBy("callee").agg(F.count("*").alias("calls"))
    used = calls.join(F.broadcast(dims.rules(s.spark)), F.col("callee") == F.col("rule_fn"), "right")
    return used.groupBy("sink_type").agg(
        F.count("*").alias("n"), F.count_if("sink").alias("sinks"), F.count_if("bounded").alias("bounded"), F.round(F.sum("vuln_score"), 4).alias("score"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count("calls").alias("called")
    )


@query("j01_library_match", f"SELECT fn, seq, callee, rule_fn IS NOT NULL AS known, sink_type FROM {_M}")
def j01(s: Source) -> DataFrame:
    return _matched(s).select("fn", "seq", "callee", F.col("rule_fn").isNotNull().alias("known"), "sink_type")


@query("r10_call_score", f"SELECT fn, seq, callee, {_SCORE} AS score FROM {_M}")
def r10(s: Source) -> DataFrame:
    return _matched(s).select("fn", "seq", "callee", match.call_score().alias("score"))


_RISK = f"""SELECT fn, round(sum({_SCORE}), 2) AS score, count_if(sink) AS sinks, count_if(n_in > 0 OR all_ptr) AS sources,
 coalesce(arg_min(sink_type, CASE sink_type WHEN 'command_injection' THEN 0 WHEN 'buffer_overflow' THEN 1 WHEN 'format_string' THEN 2 END) FILTER (WHERE sink AND sink_type IN ('command_injection', 'buffer_overflow', 'format_string')), '') AS top_sink
 FROM {_M} WHERE rule_fn IS NOT NULL GROUP BY fn"""


@query("a10_function_risk", _RISK)
def a10(s: Source) -> DataFrame:
    return match.function_risk(_matched(s))


@query("t02_top_functions", f"SELECT * FROM ({_RISK}) t ORDER BY score DESC, fn LIMIT 20")
def t02(s: Source) -> DataFrame:
    return match.top_functions(match.function_risk(_matched(s)), 20)


@query("j06_unknown_calls", f"SELECT fn, seq, callee FROM {_M} WHERE rule_fn IS NULL")
def j06(s: Source) -> DataFrame:
    return match.unknown_calls(_calls(s), dims.rules(s.spark)).select("fn", "seq", "callee")


@query("k10_known_matches", f"SELECT callee, count(*) AS n FROM {_M} WHERE rule_fn IS NOT NULL GROUP BY callee")
def k10(s: Source) -> DataFrame:
    return _matched(s).filter("rule_fn IS NOT NULL").groupBy("callee").agg(F.count("*").alias("n"))


_STRUCT = """SELECT concat(CAST(n_nationkey % 2 * 4 + 4 AS VARCHAR), ',8', CASE WHEN n_nationkey % 3 = 0 THEN '|1' ELSE '|0' END) AS skey, n_name AS rule_fn, 0.5 + n_nationkey / 100.0 AS confidence, n_nationkey % 5 AS hit_count, n_nationkey % 3 = 0 AS ret_exists FROM nation"""


@query("j02_structural_top1", f"SELECT skey, rule_fn, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY confidence DESC, hit_count DESC, rule_fn) AS n FROM ({_STRUCT}) t) u WHERE n = 1")
def j02(s: Source) -> DataFrame:
    n = F.col("n_nationkey")
    rules = s.nation.select(match.structural_key(F.array(n % 2 * 4 + 4, F.lit(8)), n % 3 == 0).alias("skey"), F.col("n_name").alias("rule_fn"), (0.5 + n / 100.0).alias("confidence"), (n % 5).alias("hit_count"))
    return match.best_structural(rules).select("skey", "rule_fn", "confidence")


@query("j04_match_cascade", f"""
WITH c AS (SELECT fn, seq, CASE WHEN event_id % 12 IN (9, 10) AND event_id % 2 = 0 THEN '0x' || callee ELSE callee END AS callee, CAST(in_size AS VARCHAR) || ',' || CAST(in_size AS VARCHAR) || '|1' AS skey FROM b_ops WHERE op = 'CALL' AND callee IS NOT NULL)
SELECT fn, seq, c.callee, CASE WHEN rule_fn IS NOT NULL THEN 'LIBRARY_MATCH' WHEN starts_with(c.callee, '0x') AND skey = '8,8|1' THEN 'STRUCTURAL_MATCH' WHEN c.callee = 'xmlStrlen' THEN 'LEARNED_MATCH' ELSE 'NO_MATCH' END AS match_kind,
  CASE WHEN rule_fn IS NOT NULL THEN confidence WHEN starts_with(c.callee, '0x') AND skey = '8,8|1' THEN 0.7::DOUBLE WHEN c.callee = 'xmlStrlen' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM c LEFT JOIN {_RULES} ON r.rule_fn = c.callee""")
def j04(s: Source) -> DataFrame:
    dressed = F.when((F.col("event_id") % 12).isin(9, 10) & (F.col("event_id") % 2 == 0), F.concat(F.lit("0x"), F.col("callee"))).otherwise(F.col("callee"))
    calls = match.calls(ops.of_bridge(s.b_ops.withColumn("callee", dressed)))
    structural = s.spark.createDataFrame([("8,8|1", "a", 0.7, 3.0, 2, True), ("8,8|1", "b", 0.6, 9.0, 9, True)], "skey string, rule_fn string, confidence double, vuln_score double, hit_count int, ret_exists boolean")
    learned = s.spark.createDataFrame([("xmlStrlen", 0.6, 2.0, "copy"), ("fn_9", 0.9, 2.0, "logger")], "rule_fn string, confidence double, vuln_score double, role string")
    return match.cascade(calls, dims.rules(s.spark), structural, learned).select("fn", "seq", "callee", "match_kind", "confidence")


@query("p31_rule_effects", f"""
SELECT fn, seq, callee, coalesce(n_in > 0 OR all_ptr, false) AS is_external_source,
  CASE WHEN all_ptr AND in_size = 8 THEN in1 || ',' || in2 WHEN all_ptr THEN '' WHEN writes_at = 0 THEN in1 WHEN writes_at = 1 THEN in2 ELSE '' END AS written,
  CASE WHEN reads_from = 0 THEN in1 WHEN reads_from = 1 THEN in2 END AS source_var FROM {_M}""")
def p31(s: Source) -> DataFrame:
    e = match.effects(_matched(s))
    return e.select("fn", "seq", "callee", F.coalesce("is_external_source", F.lit(False)).alias("is_external_source"), F.array_join("written", ",").alias("written"), "source_var")


@query("p32_no_match_default", f"SELECT fn, seq, coalesce(confidence, 0.0) AS confidence, coalesce(vuln_score, 0.0) AS vuln_score, CASE WHEN rule_fn IS NULL THEN in_size = 8 ELSE rt END AS return_tainted FROM {_M}")
def p32(s: Source) -> DataFrame:
    m = _matched(s)
    tainted = F.when(F.col("rule_fn").isNull(), F.get("sizes", 0) == 8).otherwise(F.col("return_tainted"))
    return m.select("fn", "seq", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("vuln_score", F.lit(0.0)).alias("vuln_score"), tainted.alias("return_tainted"))


@query("j19_argument_effects", """
SELECT fn, seq, callee, CAST(i AS INTEGER) AS arg_idx, CASE i WHEN 0 THEN in1 ELSE in2 END AS var, effect
FROM b_ops JOIN (VALUES ('memcpy', 0, 'mem:0'), ('memcpy', 1, 'return'), ('strcpy', 1, 'mem:0')) e(c, i, effect) ON callee = c WHERE op = 'CALL'""")
def j19(s: Source) -> DataFrame:
    e = s.spark.createDataFrame([("memcpy", 0, "mem:0"), ("memcpy", 1, "return"), ("strcpy", 1, "mem:0")], "callee string, arg_idx int, effect string")
    return match.argument_effects(_calls(s), e).select("fn", "seq", "callee", "arg_idx", "var", "effect")


_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{p}')" for p in ps.split()) + f" THEN '{role}'" for role, ps in dims.ROLE_PATTERNS.items()) + " END"
_ROLE_CONF = "CASE " + " ".join(f"WHEN contains(x, '{p}') THEN {0.90 if len(p) >= 6 else 0.75}::DOUBLE" for ps in dims.ROLE_PATTERNS.values() for p in ps.split()) + " END"


@query("p16_role_by_name", f"SELECT page_id, {_ROLE} AS role, {_ROLE_CONF} AS role_conf FROM (SELECT page_id, lower(url) || '_' || CASE page_id % 7 WHEN 0 THEN 'parse_x' WHEN 1 THEN 'crc' WHEN 2 THEN 'write_y' WHEN 3 THEN 'handle_error' WHEN 4 THEN 'walk_list' ELSE 'zz' END AS x FROM pages) t")
def p16(s: Source) -> DataFrame:
    k = F.col("page_id") % 7
    suffix = F.when(k == 0, "parse_x").when(k == 1, "crc").when(k == 2, "write_y").when(k == 3, "handle_error").when(k == 4, "walk_list").otherwise("zz")
    x = F.lower(F.concat(F.col("url"), F.lit("_"), suffix))
    return patterns.with_role(s.pages.select("page_id", x.alias("x")), "x").select("page_id", "role", "role_conf")


_CAT = "CASE " + " ".join(f"WHEN role = '{k}' THEN '{v}'" for k, v in dims.ROLE_CATEGORY.items()) + " END"


PROFILE = f"WITH c AS (SELECT {_CAT} AS category, count(*) AS n FROM (SELECT {_ROLE} AS role FROM (SELECT lower(callee) AS x FROM b_ops WHERE callee IS NOT NULL) t) u WHERE role IS NOT NULL GROUP BY 1) SELECT category, n, round(n / sum(n) OVER (), 6) AS share FROM c"


@query("a12_binary_profile", PROFILE)
def a12(s: Source) -> DataFrame:
    return select.profile(s.b_ops.filter("callee IS NOT NULL"), "callee")


_SRC = "CASE WHEN callee IN (" + ", ".join(repr(x) for x in dims.NOT_SOURCES) + ") THEN NULL " + " ".join("WHEN callee IN (" + ", ".join(repr(x) for x in v.split()) + f") THEN '{k}'" for k, v in dims.SOURCE_ROLES.items()) + " " + " ".join(f"WHEN contains(lower(callee), '{p}') THEN '{r}'" for p, r in dims.SOURCE_FALLBACKS) + " ELSE 'UNKNOWN' END"
_SRC_CONF = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in dims.SOURCE_CONFIDENCE.items()) + " ELSE 0.0::DOUBLE END"


@query("p23_source_role", f"SELECT callee, role, {_SRC_CONF} AS base_conf, n FROM (SELECT callee, {_SRC} AS role, count(*) AS n FROM b_ops WHERE callee IS NOT NULL GROUP BY 1, 2) t")
def p23(s: Source) -> DataFrame:
    counts = s.b_ops.filter("callee IS NOT NULL").groupBy("callee").agg(F.count("*").alias("n"))
    return patterns.with_source_role(counts, "callee").select("callee", "role", sources.base_confidence(F.col("role")).alias("base_conf"), "n")


_SINKS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, '{n.lower()}') OR contains('{n.lower()}', x)" for n in v) + f" THEN '{k}'" for k, v in dims.SINK_CLASSES.items()) + " ELSE 'GENERIC' END"


@query("p26_sink_class", f"SELECT callee, {_SINKS} AS sink_class FROM (SELECT DISTINCT callee, lower(callee) AS x FROM b_ops WHERE callee IS NOT NULL) t")
def p26(s: Source) -> DataFrame:
    return patterns.with_sink_class(s.b_ops.filter("callee IS NOT NULL").select("callee").distinct(), "callee")


@query("p27_sink_verify", """
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS cand_id, CASE l_linenumber % 5 WHEN 0 THEN 'ALLOCATOR' WHEN 1 THEN 'COPY' WHEN 2 THEN 'FORMAT' WHEN 3 THEN 'FREE' ELSE 'GENERIC' END AS c,
  CAST(round(l_quantity) AS INT) / 50.0 AS conf, l_returnflag = 'A' AS mult, l_linestatus = 'F' AS chk FROM lineitem)
SELECT cand_id, CASE c WHEN 'ALLOCATOR' THEN NOT chk AND mult AND conf >= 0.4 WHEN 'COPY' THEN conf >= 0.5 WHEN 'FORMAT' THEN conf >= 0.7 WHEN 'FREE' THEN mult ELSE conf >= 0.3 END AS emit,
  round(CASE c WHEN 'ALLOCATOR' THEN CASE WHEN NOT chk AND mult AND conf >= 0.4 THEN least(conf * 0.95, 0.9) ELSE 0 END WHEN 'COPY' THEN CASE WHEN conf < 0.5 THEN 0 WHEN chk THEN conf * 0.45 ELSE least(conf * 0.9, 0.85) END
  WHEN 'FORMAT' THEN CASE WHEN conf < 0.7 THEN 0 ELSE least(conf * 0.85, 0.8) END WHEN 'FREE' THEN CASE WHEN mult THEN 0.75 ELSE 0 END ELSE CASE WHEN conf < 0.3 THEN 0 ELSE least(conf * 0.85, 0.8) END END::DOUBLE, 4) AS adj_conf FROM v""")
def p27(s: Source) -> DataFrame:
    k = F.col("l_linenumber") % 5
    c = F.when(k == 0, "ALLOCATOR").when(k == 1, "COPY").when(k == 2, "FORMAT").when(k == 3, "FREE").otherwise("GENERIC")
    rows = s.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_id"), c.alias("sink_class"), (F.round("l_quantity").cast("int") / 50.0).alias("conf"), (F.col("l_returnflag") == "A").alias("mult"), (F.col("l_linestatus") == "F").alias("checked"))
    verdict = sources.verify_sink(F.col("sink_class"), F.col("conf"), F.col("mult"), F.col("checked"), F.col("mult"))
    return rows.select("cand_id", verdict["emit"].alias("emit"), F.round(verdict["conf"], 4).alias("adj_conf"))


@query("e01_source_seeds", f"""
WITH c AS (SELECT fn, seq, {_SRC} AS role, callee, out_var, in1, in2, in_size FROM b_ops WHERE callee IS NOT NULL),
k AS (SELECT *, {_SRC_CONF} AS conf FROM c WHERE role IS NOT NULL AND role <> 'UNKNOWN'),
v AS (SELECT fn, seq, 0 AS slot, out_var AS var, conf, callee FROM k UNION ALL SELECT fn, seq, 1, in1, conf, callee FROM k WHERE in_size = 8 AND NOT starts_with(in1, 'const') UNION ALL SELECT fn, seq, 2, in2, conf, callee FROM k WHERE in_size = 8 AND NOT starts_with(in2, 'const'))
SELECT fn, var, conf, callee FROM (SELECT *, row_number() OVER (PARTITION BY fn, var ORDER BY conf DESC, seq, slot) AS n FROM v) t WHERE n = 1""")
def e01(s: Source) -> DataFrame:
    return sources.seeds(ops.of_bridge(s.b_ops))


@query("j22_contains_any", "SELECT doc_id, contains(lower(text), 'moron') OR contains(lower(text), 'licensed') OR contains(lower(text), '@') AS hit FROM documents")
def j22(s: Source) -> DataFrame:
    found = patterns.matched_rows(s.documents.select("doc_id", F.lower("text").alias("low")), "low", ["moron", "licensed", "@"])
    return found.select("doc_id", F.when(F.col("low").isNotNull(), patterns.any_of()).alias("hit"))


@query("p40_price_lookup", """
SELECT stage, sum(tokens) AS tokens, round(sum(tokens) / 1000.0 * CASE stage WHEN 'user' THEN 0.5 WHEN 'assistant' THEN 1.5 ELSE 1.0 END, 6) AS cost FROM b_calls GROUP BY stage""")
def p40(s: Source) -> DataFrame:
    price = names.first_contained(F.col("stage"), [("user", 0.5), ("assistant", 1.5)], 1.0)
    g = s.b_calls.groupBy("stage").agg(F.sum("tokens").alias("tokens"))
    return g.select("stage", "tokens", F.round(F.col("tokens") / 1000.0 * price, 6).alias("cost"))
