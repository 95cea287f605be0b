"""Queries over further projections, joins, sets, scores and service tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import evidence, fuse, graph, ops, select
from ..sources import external
from .base import Source, query


@query("p02_call_target", "SELECT event_id, CASE WHEN op = 'CALL' AND callee IS NOT NULL AND NOT starts_with(callee, '0x') THEN 'external' WHEN starts_with(in1, 'const') THEN 'const' ELSE 'unique' END AS space FROM b_ops")
def p02(s: Source) -> DataFrame:
    return s.b_ops.select("event_id", ops.operand_space(F.col("op"), F.col("callee"), F.col("in1")).alias("space"))


@query("p03_target_resolution", "SELECT event_id, coalesce(t.name, y.name, '0x' || lower(hex(k))) AS target FROM b_ops b LEFT JOIN (SELECT s_suppkey AS a, s_name AS name FROM supplier) t ON t.a = b.k LEFT JOIN (SELECT p_partkey AS a, p_name AS name FROM part) y ON y.a = b.k")
def p03(s: Source) -> DataFrame:
    functions, symbols = s.supplier.selectExpr("s_suppkey AS address", "s_name AS name"), s.part.selectExpr("p_partkey AS address", "p_name AS name")
    return ops.resolved_targets(s.b_ops, functions, symbols, "k").select("event_id", "target")


@query("p07_strict_constant", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(k AS BIGINT) END AS value FROM b_ops")
def p07(s: Source) -> DataFrame:
    text, space = F.concat(F.lit("const(0x"), F.lower(F.hex("k")), F.lit(")")), F.when(F.col("event_id") % 2 == 0, "const").otherwise("unique")
    return s.b_ops.select("event_id", names.constant(text, space, strict=True).cast("long").alias("value"))


@query("p18_role_cascade", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'parser' END, CASE WHEN s_suppkey % 5 = 0 THEN 'copy' END, 'unknown') AS role, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 0.75 END, CASE WHEN s_suppkey % 5 = 0 THEN 0.8 END, 0.0)::DOUBLE AS conf FROM supplier")
def p18(s: Source) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "png_read_row").otherwise("zz")
    stored, stored_conf = F.when(k % 5 == 0, "copy"), F.when(k % 5 == 0, 0.80)
    return s.supplier.select("s_suppkey", F.coalesce(select.role_by_name(name), stored, F.lit("unknown")).alias("role"), F.coalesce(select.role_confidence(name), stored_conf, F.lit(0.0)).alias("conf"))


@query("p20_write_path", "SELECT s_suppkey FROM supplier WHERE NOT (s_suppkey % 4 = 0 AND s_suppkey % 3 = 0)")
def p20(s: Source) -> DataFrame:
    k = F.col("s_suppkey")
    fn = F.when(k % 3 == 0, "png_write_chunk").otherwise("png_get")
    return s.supplier.filter(~((F.when(k % 4 == 0, 0.0).otherwise(1.0) == 0) & names.contains_any(fn, ["write", "encode", "emit"]))).select("s_suppkey")


@query("p28_library_guess", "SELECT page_id, CASE WHEN regexp_matches(u, 'png|libpng') THEN 'libpng (PNG image decoder)' WHEN regexp_matches(u, 'tiff|tif') THEN 'libtiff (TIFF image decoder)' WHEN regexp_matches(u, 'xml|html') THEN 'libxml2 (XML/HTML parser)' WHEN regexp_matches(u, 'sqlite|sql') THEN 'SQLite (embedded database)' WHEN regexp_matches(u, 'snd|sf_|psf_|audio|wav') THEN 'libsndfile (audio decoder)' ELSE 'unknown' END AS library FROM (SELECT page_id, lower(url) || CASE page_id % 4 WHEN 0 THEN '_PNG' WHEN 1 THEN '_sql' WHEN 2 THEN '_wav' ELSE '' END AS u0, lower(u0) AS u FROM pages) t")
def p28(s: Source) -> DataFrame:
    k = F.col("page_id") % 4
    return s.pages.select("page_id", evidence.library_of(F.concat(F.col("url"), F.when(k == 0, "_PNG").when(k == 1, "_sql").when(k == 2, "_wav").otherwise(""))).alias("library"))


@query("p33_return_penalty", "SELECT cand_id, CASE WHEN cand_id % 2 = 0 THEN greatest(0.3, conf_pct / 100 * 0.6) ELSE conf_pct / 100 END AS conf FROM b_candidates")
def p33(s: Source) -> DataFrame:
    c = F.col("conf_pct") / 100
    return s.b_candidates.select("cand_id", F.when(F.col("cand_id") % 2 == 0, F.greatest(F.lit(0.3), c * 0.6)).otherwise(c).alias("conf"))


@query("p34_rule_of_summary", """
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'integer_overflow' WHEN 1 THEN 'buffer_overflow' WHEN 2 THEN '' WHEN 3 THEN 'command_injection' END AS sink_type, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS return_tainted,
  CASE s_suppkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 8 END AS vuln_score, CASE s_suppkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN -1 END AS writes_at FROM supplier""")
def p34(s: Source) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(x) for x in ("allocator", "copy", "read_input", "exec", "logger")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    r = evidence.rule_of_summary(role, F.lit(None).cast("int"), F.lit(None).cast("double"))
    return s.supplier.select("s_suppkey", r["sink_type"].alias("sink_type"), r["return_tainted"].alias("return_tainted"), r["vuln_score"].alias("vuln_score"), r["writes_at"].alias("writes_at"))


@query("p35_answer_parsing", "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) END AS k FROM events")
def p35(s: Source) -> DataFrame:
    fenced = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))
    text = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no answer")
    return s.events.select("event_id", external.parsed(text, "k int")["k"].alias("k"))


@query("p36_size_inference", "SELECT fn, coalesce(string_agg(CAST(in_size AS VARCHAR), ',' ORDER BY seq) FILTER (WHERE n <= 6), '8') AS sizes FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY seq) AS n FROM b_ops WHERE seq < 10 AND out_var IS NOT NULL) t GROUP BY fn")
def p36(s: Source) -> DataFrame:
    first = s.b_ops.filter("seq < 10 AND out_var IS NOT NULL").groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("seq", "in_size"))).alias("x"))
    return first.select("fn", F.array_join(F.transform(F.slice("x", 1, 6), lambda v: v["in_size"].cast("string")), ",").alias("sizes"))


@query("p41_causal_chain", "SELECT cand_id, 'recv[external_input] -> ' || CASE WHEN cand_id % 2 = 0 THEN 'decode[propagates_taint] -> ' ELSE '' END || sink_fn || '[sink] -> IMPACT[' || vuln_type || ']' AS chain FROM b_candidates")
def p41(s: Source) -> DataFrame:
    path = F.array(F.lit("var1"), F.when(F.col("cand_id") % 2 == 0, " decode ").otherwise("recv"), F.lit("decode" * 12), F.col("sink_fn"), F.when(F.col("cand_id") % 2 == 0, "decode").otherwise(""))
    return s.b_candidates.select("cand_id", evidence.causal_chain(F.lit("recv"), path, F.col("sink_fn"), F.col("vuln_type")).alias("chain"))


@query("p42_op_lines", "SELECT fn, string_agg(CAST(seq AS VARCHAR) || ' ' || op || coalesce(' ' || callee, ''), chr(10) ORDER BY seq) AS window_text FROM b_ops WHERE seq BETWEEN 5 AND 25 GROUP BY fn")
def p42(s: Source) -> DataFrame:
    line = F.concat(F.col("seq").cast("string"), F.lit(" "), F.col("op"), F.coalesce(F.concat(F.lit(" "), F.col("callee")), F.lit("")))
    rows = ops.context(s.b_ops.withColumn("op", line), s.b_ops.select("fn", F.lit(15).alias("at")).distinct(), 10)
    return rows.groupBy("fn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "op"))), lambda x: x["op"]), "\n").alias("window_text"))


@query("p43_op_sample", "SELECT fn, seq FROM (SELECT fn, seq, row_number() OVER (PARTITION BY fn ORDER BY tier, seq) AS n FROM (SELECT b.fn, b.seq, min(CASE WHEN b.seq < 5 THEN 0 WHEN c.seq IS NOT NULL THEN 1 ELSE 2 END) AS tier FROM b_ops b LEFT JOIN b_ops c ON c.fn = b.fn AND c.op = 'STORE' AND abs(c.seq - b.seq) <= 2 GROUP BY b.fn, b.seq) t) u WHERE n <= 30")
def p43(s: Source) -> DataFrame:
    b = s.b_ops
    near = ops.context(b, b.filter("op = 'STORE'").select("fn", F.col("seq").alias("at")), 2).select("fn", "seq", F.lit(1).alias("near")).distinct()
    tier = F.when(F.col("seq") < 5, 0).when(F.col("near") == 1, 1).otherwise(2)
    ranked = b.join(near, ["fn", "seq"], "left").withColumn("_n", F.row_number().over(Window.partitionBy("fn").orderBy(tier, "seq")))
    return ranked.filter("_n <= 30").select("fn", "seq")


@query("j07_address_join", "SELECT p_partkey, s_name FROM part JOIN supplier ON s_suppkey = p_partkey")
def j07(s: Source) -> DataFrame:
    left = s.part.withColumn("a", names.address(F.concat(F.lit("ram(0x00"), F.hex("p_partkey"), F.lit(")"))))
    right = s.supplier.withColumn("a", names.entry_address(F.concat(F.lit("0000"), F.hex("s_suppkey"))))
    return left.join(right, "a").select("p_partkey", "s_name")


@query("j16_evidence_by_id", "SELECT a.cand_id, count(*) AS n FROM (SELECT DISTINCT cand_id FROM b_candidates WHERE conf_pct > 90) a JOIN b_candidates b ON b.cand_id = a.cand_id GROUP BY a.cand_id")
def j16(s: Source) -> DataFrame:
    return s.b_candidates.join(s.b_candidates.filter("conf_pct > 90").select("cand_id").distinct(), "cand_id").groupBy("cand_id").agg(F.count("*").alias("n"))


@query("j20_source_priority", """
WITH seed AS (SELECT DISTINCT fn, out_var AS var, CASE callee WHEN 'recv' THEN 1.0 ELSE 0.65 END AS conf FROM b_ops WHERE callee IN ('recv', 'getenv'))
SELECT b.fn, b.seq, coalesce(a.conf, c.conf, CASE WHEN b.event_id % 9 = 0 THEN 0.9 END, 0.0)::DOUBLE AS conf FROM b_ops b LEFT JOIN seed a ON a.fn = b.fn AND a.var = b.in1 LEFT JOIN seed c ON c.fn = b.fn AND c.var = b.in2 WHERE b.op = 'STORE'""")
def j20(s: Source) -> DataFrame:
    seed = s.b_ops.filter("callee IN ('recv', 'getenv')").select("fn", F.col("out_var").alias("var"), F.when(F.col("callee") == "recv", 1.0).otherwise(0.65).alias("c")).distinct()
    st = s.b_ops.filter("op = 'STORE'")
    one = st.join(seed.select("fn", F.col("var").alias("in1"), F.col("c").alias("c1")), ["fn", "in1"], "left").join(seed.select("fn", F.col("var").alias("in2"), F.col("c").alias("c2")), ["fn", "in2"], "left")
    return one.select("fn", "seq", F.coalesce("c1", "c2", F.when(F.col("event_id") % 9 == 0, 0.9), F.lit(0.0)).alias("conf"))


@query("j21_same_type_else_any", """
WITH s AS (SELECT fn, vuln_type, max(conf_pct) AS c FROM b_candidates WHERE match_kind = 'NO_MATCH' AND conf_pct > 98 GROUP BY 1, 2), a AS (SELECT fn, max(c) AS c FROM s GROUP BY fn)
SELECT b.fn, b.vuln_type, coalesce(s.c, a.c, 0) AS best FROM (SELECT DISTINCT fn, vuln_type FROM b_candidates) b LEFT JOIN s ON s.fn = b.fn AND s.vuln_type = b.vuln_type LEFT JOIN a ON a.fn = b.fn""")
def j21(s: Source) -> DataFrame:
    sem = s.b_candidates.filter("match_kind = 'NO_MATCH' AND conf_pct > 98").groupBy("fn", "vuln_type").agg(F.max("conf_pct").alias("same"))
    whole = sem.groupBy("fn").agg(F.max("same").alias("any"))
    return s.b_candidates.select("fn", "vuln_type").distinct().join(sem, ["fn", "vuln_type"], "left").join(whole, "fn", "left").select("fn", "vuln_type", F.coalesce("same", "any", F.lit(0)).alias("best"))


@query("a24_semantic_confidence", "SELECT fn, max(conf_pct) AS most, round(avg(conf_pct), 6) AS mean FROM b_sem WHERE conf_pct >= 40 GROUP BY fn")
def a24(s: Source) -> DataFrame:
    return s.b_sem.filter("conf_pct >= 40").groupBy("fn").agg(F.max("conf_pct").alias("most"), F.round(F.avg("conf_pct"), 6).alias("mean"))


@query("a25_trace_counts", "SELECT match_kind, vuln_type, count(*) AS n, count(DISTINCT fn) AS functions FROM b_candidates GROUP BY 1, 2")
def a25(s: Source) -> DataFrame:
    return s.b_candidates.groupBy("match_kind", "vuln_type").agg(F.count("*").alias("n"), F.count_distinct("fn").alias("functions"))


@query("w08_percentile_index", "SELECT p_brand, p_size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) t WHERE r = n // 4 + 1")
def w08(s: Source) -> DataFrame:
    w = Window.partitionBy("p_brand")
    ranked = s.part.select("p_brand", "p_size", F.row_number().over(w.orderBy(F.desc("p_size"), "p_partkey")).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.filter("r = floor(n / 4) + 1").select("p_brand", "p_size")


@query("t03_top_candidates", "SELECT cand_id, conf_pct FROM b_candidates ORDER BY conf_pct DESC, cand_id LIMIT 25")
def t03(s: Source) -> DataFrame:
    return s.b_candidates.orderBy(F.desc("conf_pct"), "cand_id").limit(25).select("cand_id", "conf_pct")


@query("t05_orthogonal_budget", "SELECT fn, sum(conf_pct) AS score FROM b_sem GROUP BY fn ORDER BY score DESC, fn LIMIT 15")
def t05(s: Source) -> DataFrame:
    return s.b_sem.groupBy("fn").agg(F.sum("conf_pct").alias("score")).orderBy(F.desc("score"), "fn").limit(15)


@query("t07_severity_sort", "SELECT cand_id, vuln_type FROM b_candidates ORDER BY CASE vuln_type WHEN 'write_what_where' THEN 0 WHEN 'integer_overflow' THEN 2 ELSE 1 END, cand_id, vuln_type LIMIT 200")
def t07(s: Source) -> DataFrame:
    return s.b_candidates.orderBy(select.severity_rank(fuse.default_severity(F.col("vuln_type"))).desc(), "cand_id", "vuln_type").limit(200).select("cand_id", "vuln_type")


@query("t10_suppressions_by_count", "SELECT fn, vuln_type, count(*) AS n, max(cand_id) AS last FROM b_candidates GROUP BY 1, 2 ORDER BY n DESC, last DESC, fn LIMIT 30")
def t10(s: Source) -> DataFrame:
    g = s.b_candidates.groupBy("fn", "vuln_type").agg(F.count("*").alias("n"), F.max("cand_id").alias("last"))
    return g.orderBy(F.desc("n"), F.desc("last"), "fn").limit(30)


@query("u03_array_intersection", "SELECT fn, len(list_intersect(list(DISTINCT callee), ['malloc', 'free', 'recv'])) AS n FROM b_ops GROUP BY fn")
def u03(s: Source) -> DataFrame:
    return s.b_ops.groupBy("fn").agg(F.size(F.array_intersect(F.collect_set("callee"), F.array(*[F.lit(x) for x in ("malloc", "free", "recv")]))).cast("long").alias("n"))


@query("u04_union_of_seeds", "SELECT fn, out_var AS var FROM b_ops WHERE callee = 'recv' UNION SELECT fn, in1 FROM b_ops WHERE callee = 'fread'")
def u04(s: Source) -> DataFrame:
    return s.b_ops.filter("callee = 'recv'").select("fn", F.col("out_var").alias("var")).unionByName(s.b_ops.filter("callee = 'fread'").select("fn", F.col("in1").alias("var"))).distinct()


@query("u06_merge_trackers", "SELECT stage, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM b_calls GROUP BY stage")
def u06(s: Source) -> DataFrame:
    part = lambda k: s.b_calls.filter(F.col("conv_id") % 2 == k).groupBy("stage").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    return part(0).unionByName(part(1)).groupBy("stage").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))


@query("k04_callee_roles", "SELECT callee, arg_max(role, seq) AS role FROM (SELECT callee, seq * 1000000 + event_id AS seq, CASE seq % 3 WHEN 0 THEN 'copy' WHEN 1 THEN 'logger' ELSE 'exec' END AS role FROM b_ops WHERE callee IS NOT NULL) t GROUP BY callee")
def k04(s: Source) -> DataFrame:
    role = F.when(F.col("seq") % 3 == 0, "copy").when(F.col("seq") % 3 == 1, "logger").otherwise("exec")
    rows = s.b_ops.filter("callee IS NOT NULL").select("callee", role.alias("role"), (F.col("seq") * 1000000 + F.col("event_id")).alias("version"))
    return rows.groupBy("callee").agg(F.max_by("role", "version").alias("role"))


@query("k12_call_cost", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN greatest(1, length(text) // 4) ELSE 200 END AS tokens FROM conversations")
def k12(s: Source) -> DataFrame:
    return s.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, external.tokens(F.col("text"))).otherwise(200).alias("tokens"))


@query("k15_evaluation_set", """
WITH a AS (SELECT fn, 0 AS phase FROM b_ops WHERE fn IN ('fn_1', 'fn_2', 'fn_nope') UNION SELECT fn, 1 FROM b_ops WHERE callee = 'recv' UNION SELECT fn, 2 FROM b_ops WHERE callee = 'system')
SELECT fn, phase FROM (SELECT fn, min(phase) AS phase FROM a GROUP BY fn) t ORDER BY phase, fn LIMIT 12""")
def k15(s: Source) -> DataFrame:
    b = s.b_ops
    return select.evaluation_set(b.filter("fn IN ('fn_1', 'fn_2', 'fn_nope')"), b.filter("callee = 'recv'"), b.filter("callee = 'system'"), 12)


@query("g12_freed_fields", """
SELECT DISTINCT p.fn, p.in1 AS base, p.in2 AS field FROM b_ops p JOIN b_ops l ON l.fn = p.fn AND l.op = 'LOAD' AND p.out_var IN (l.in1, l.in2) JOIN b_ops f ON f.fn = p.fn AND f.callee IN ('free', 'system', 'printf') AND l.out_var IN (f.in1, f.in2) WHERE p.op = 'PTRSUB'""")
def g12(s: Source) -> DataFrame:
    b = ops.of_bridge(s.b_ops)
    sub = b.filter("op = 'PTRSUB'").select("fn", F.col("out_var").alias("var"), F.col("args")[0].alias("base"), F.col("args")[1].alias("field"))
    load = ops.uses(b.filter("op = 'LOAD'")).select("fn", "seq", "var").join(ops.defs(b.filter("op = 'LOAD'")).select("fn", "seq", F.col("var").alias("loaded")), ["fn", "seq"]).drop("seq")
    free = ops.uses(b.filter("callee IN ('free', 'system', 'printf')")).select("fn", F.col("var").alias("loaded"))
    return sub.join(load, ["fn", "var"]).join(free, ["fn", "loaded"]).select("fn", "base", "field").distinct()


@query("g13_argument_order", "SELECT fn, seq, CAST(row_number() OVER (PARTITION BY fn, seq ORDER BY slot) - 1 AS INTEGER) AS position, var FROM (SELECT fn, seq, 0 AS slot, in1 AS var FROM b_ops WHERE op = 'CALL' UNION ALL SELECT fn, seq, 1, in2 FROM b_ops WHERE op = 'CALL') t WHERE NOT starts_with(var, 'const')")
def g13(s: Source) -> DataFrame:
    rows = ops.uses(ops.of_bridge(s.b_ops).filter("op = 'CALL'")).filter("NOT var LIKE 'const%'")
    return rows.select("fn", "seq", (F.row_number().over(Window.partitionBy("fn", "seq").orderBy("slot")) - 1).cast("int").alias("position"), "var")


_R = """SELECT c_custkey AS k, c_custkey % 7 AS dist, c_custkey % 3 = 0 AS reachable, c_custkey % 5 AS mults, c_custkey % 4 AS shifts, c_custkey % 6 AS pointers, c_custkey % 3 AS casts, c_custkey % 11 AS adds, c_custkey % 2 = 0 AS unchecked,
  c_custkey % 50 + 5 AS n, c_custkey % 9 AS cb, c_custkey % 5 AS ls, (c_custkey % 10) / 10 AS ppr, c_custkey % 4 = 0 AS dangerous, c_custkey % 40 AS fan, c_custkey % 8 AS lo, c_custkey % 6 AS st, c_custkey % 7 = 0 AS heap, c_custkey % 2 AS ic, c_custkey % 3 AS sc, (c_custkey % 30)::DOUBLE AS pts,
  CASE c_custkey % 5 WHEN 0 THEN 'parser' WHEN 1 THEN 'validator' WHEN 2 THEN 'dispatcher' WHEN 3 THEN 'wrapper' ELSE 'unknown' END AS role, CASE WHEN c_custkey % 5 = 4 THEN 0.0 ELSE 0.75 END::DOUBLE AS rc, CASE WHEN c_custkey % 2 = 0 THEN 'int f(int size)' ELSE 'int f()' END AS proto FROM customer"""
_CASE = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0 END"
_PARTS = {
    "exposure": f"{_CASE('reachable', 0.35)} + CASE WHEN dist <= 1 THEN 0.5 WHEN dist = 2 THEN 0.35 WHEN dist = 3 THEN 0.2 WHEN dist = 4 THEN 0.1 ELSE 0 END + {_CASE('ic > 0', 0.2)} + CASE WHEN role = 'parser' THEN rc * 0.2 WHEN role = 'dispatcher' THEN rc * 0.1 ELSE 0 END",
    "arithmetic": f"least(mults * 0.25, 0.5) + least(shifts * 0.1, 0.2) + least(pointers * 0.1, 0.2) + least(casts * 0.08, 0.15) + least(adds * 0.02, 0.15) + {_CASE('unchecked', 0.35)} + {_CASE(chr(39) + 'size' + chr(39) + ' = regexp_extract(proto, ' + chr(39) + 'size' + chr(39) + ')', 0.1)}",
    "validation": f"least(cb / n * 10, 0.35) + least(ls * 0.08, 0.25) + CASE WHEN role = 'validator' THEN rc * 0.35 ELSE 0 END + {_CASE('role = ' + chr(39) + 'parser' + chr(39) + ' AND mults > 0', 0.15)} + {_CASE('unchecked', 0.2)}",
    "graph": f"(ppr * 0.6 + {_CASE('reachable', 0.2)} + {_CASE('dangerous', 0.2)}) * CASE WHEN fan > 30 THEN 0.5 ELSE 1 END",
    "semantic": "CASE role WHEN 'parser' THEN 0.5 WHEN 'validator' THEN 0.5 WHEN 'dispatcher' THEN 0.35 WHEN 'unknown' THEN 0 ELSE 0.2 END * rc * rc",
    "pattern_store": "pts / 20",
    "memory": f"least(lo / n * 3, 0.4) + least(st / n * 3, 0.4) + {_CASE('heap', 0.15)}",
    "dangerous_calls": f"CASE WHEN sc > 0 THEN 0.7 WHEN ic > 0 THEN 0.5 ELSE 0 END + {_CASE('sc > 0', 0.2)} + {_CASE('dangerous', 0.3)}",
}
_SCORES = ", ".join(f"round(least(1.0, ({v})::DOUBLE), 6) AS {k}" for k, v in _PARTS.items())
_TOTAL = " + ".join(f"{k} * {w}::DOUBLE" for k, w in evidence.SCORE_WEIGHTS.items())


def _score_inputs(s: Source) -> DataFrame:
    k = F.col("c_custkey")
    role = F.element_at(F.array(*[F.lit(x) for x in ("parser", "validator", "dispatcher", "wrapper", "unknown")]), (k % 5 + 1).cast("int"))
    return s.customer.select(
        k.alias("fn"), (k % 7).alias("dist"), (k % 3 == 0).alias("reachable"), (k % 5).alias("mults"), (k % 4).alias("shifts"), (k % 6).alias("pointers"), (k % 3).alias("casts"), (k % 11).alias("adds"), (k % 2 == 0).alias("unchecked"), (k % 50 + 5).alias("instructions"), (k % 9).alias("cbranches"),
        (k % 5).alias("compares"), (k % 10 / 10).alias("ppr"), (k % 4 == 0).alias("dangerous"), (k % 40).alias("fan_out"), (k % 8).alias("loads"), (k % 6).alias("stores"), (k % 7 == 0).alias("heap_alloc"), F.lit(False).alias("stack_alloc"), (k % 2).alias("n_input_calls"), (k % 3).alias("n_sink_calls"),
        (k % 30).cast("double").alias("call_points"), role.alias("role"), F.when(k % 5 == 4, 0.0).otherwise(0.75).alias("role_conf"), F.when(k % 2 == 0, "int f(int size)").otherwise("int f()").alias("prototype"), F.lit(False).alias("learned"), (k % 3 > 0).alias("sink_site"), (k % 2 > 0).alias("source_site"), (k % 4 == 0).alias("dangerous_callee"),
    )


@query("r09_function_scores", f"SELECT *, round(({_TOTAL})::DECIMAL(18, 9), 4)::DOUBLE AS total FROM (SELECT k AS fn, {_SCORES} FROM ({_R}) r) t")
def r09(s: Source) -> DataFrame:
    return evidence.scores(_score_inputs(s))


@query("p37_score_reasons", f"SELECT fn, CAST(count(*) AS INTEGER) AS n, round(max(w), 4) AS largest FROM (SELECT fn, unnest([{', '.join(f'{k} * {w}::DOUBLE' for k, w in evidence.SCORE_WEIGHTS.items())}]) AS w FROM (SELECT k AS fn, {_SCORES} FROM ({_R}) r) t) u WHERE w > 0 AND round(w, 4) > 0 GROUP BY fn")
def p37(s: Source) -> DataFrame:
    r = evidence.reasons(evidence.scores(_score_inputs(s)))
    return r.filter(F.size("reasons") > 0).select("fn", F.size("reasons").alias("n"), F.col("reasons")[0]["weight"].alias("largest"))


@query("p19_category", f"SELECT fn, CASE WHEN arithmetic >= 0.6 AND arithmetic >= exposure THEN 'arithmetic' ELSE CASE fn % 5 WHEN 0 THEN 'parser' WHEN 1 THEN 'validator' WHEN 2 THEN 'state_machine' WHEN 3 THEN 'memory' ELSE 'unknown' END END AS category FROM (SELECT k AS fn, {_SCORES} FROM ({_R}) r) t")
def p19(s: Source) -> DataFrame:
    from ..functions.dims import ROLE_CATEGORY

    rows = evidence.scores(_score_inputs(s)).join(_score_inputs(s).select("fn", "role"), "fn")
    mapped = F.create_map(*[F.lit(x) for kv in ROLE_CATEGORY.items() for x in kv])[F.col("role")]
    return rows.select("fn", F.when((F.col("arithmetic") >= 0.60) & (F.col("arithmetic") >= F.col("exposure")), "arithmetic").otherwise(mapped).alias("category"))


_CALLEES = lambda r: "coalesce(bool_or(lower(callee) IN (" + ", ".join(f"'{x.lower()}'" for x in evidence.ROLE_CALLEES[r].split()) + ")), false)"


@query("e10_role_verification", f"""
WITH g AS (SELECT fn, {_CALLEES("allocator")} AS ca, {_CALLEES("read_input")} AS cr, {_CALLEES("exec")} AS ce, {_CALLEES("free")} AS cf, {_CALLEES("format_string")} AS cp, bool_or(op = 'LOAD') AS l, bool_or(op = 'STORE') AS st, bool_or(op = 'CBRANCH') AS b,
  bool_or(op IN ('INT_LESS', 'INT_EQUAL')) AS c, bool_or(op IN ('INT_LESS', 'INT_EQUAL') AND (starts_with(in1, 'const') OR starts_with(in2, 'const'))) AS cc, CAST(split_part(fn, '_', 2) AS INT) % 8 AS r FROM b_ops GROUP BY fn),
p AS (SELECT *, CASE r WHEN 0 THEN CASE WHEN ca THEN 3 ELSE 0 END + CASE WHEN NOT st THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN l AND st THEN 2 ELSE 0 END + 2 WHEN 2 THEN CASE WHEN cr THEN 4 ELSE 0 END + CASE WHEN st AND NOT l THEN 2 WHEN st THEN 1 ELSE 0 END + 1 WHEN 3 THEN CASE WHEN c THEN 2 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN cc THEN 1 ELSE 0 END ELSE 0 END AS pts FROM g)
SELECT fn, CASE WHEN r = 0 THEN CASE WHEN pts >= 3 THEN 'confirmed' WHEN pts >= 2 AND ca THEN 'weakly_confirmed' ELSE 'refuted' END WHEN r IN (1, 2, 3) THEN CASE WHEN pts >= 4 THEN 'confirmed' WHEN pts >= 2 THEN 'weakly_confirmed' ELSE 'refuted' END
  WHEN r = 4 THEN CASE WHEN ce THEN 'confirmed' ELSE 'refuted' END WHEN r = 5 THEN CASE WHEN cp THEN 'confirmed' ELSE 'refuted' END WHEN r = 6 THEN CASE WHEN cf THEN 'confirmed' ELSE 'refuted' END ELSE 'weakly_confirmed' END AS status FROM p""")
def e10(s: Source) -> DataFrame:
    signs = evidence.role_signs(ops.of_bridge(s.b_ops))
    role = F.element_at(F.array(*[F.lit(x) for x in ("allocator", "copy", "read_input", "validator", "exec", "format_string", "free", "other")]), F.substring_index("fn", "_", -1).cast("int") % 8 + 1)
    return signs.select("fn", evidence.verify_role(role, F.col("fn"), F.lit(2), F.lit(0), F.lit(False))["status"].alias("status"))


@query("e11_loop_and_pointer", "SELECT fn, bool_or(op = 'CBRANCH') AS branches, bool_or(op IN ('COPY') AND in_size = 8) AS pointer FROM b_ops GROUP BY fn")
def e11(s: Source) -> DataFrame:
    return s.b_ops.groupBy("fn").agg(F.bool_or(F.col("op") == "CBRANCH").alias("branches"), F.bool_or((F.col("op") == "COPY") & (F.col("in_size") == 8)).alias("pointer"))


@query("f05_auto_confirm", "SELECT cand_id, match_kind = 'LIBRARY_MATCH' AND NOT contains(lower(sink_fn), 'alloc') AS auto FROM b_candidates")
def f05(s: Source) -> DataFrame:
    return s.b_candidates.select("cand_id", ((F.col("match_kind") == "LIBRARY_MATCH") & ~names.contains_any(F.lower("sink_fn"), ["alloc"])).alias("auto"))


@query("f06_memory_score", "SELECT assess_id, round(least(1.0, CASE support WHEN 'Strong' THEN 0.9 WHEN 'Moderate' THEN 0.75 WHEN 'Weak' THEN 0.35 ELSE 0.1 END::DOUBLE * CASE uncertainty WHEN 'Low' THEN 1.0 WHEN 'High' THEN 0.7 ELSE 0.88 END::DOUBLE * CASE exploitability WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.92 ELSE 0.8 END::DOUBLE), 6) AS score FROM b_assess")
def f06(s: Source) -> DataFrame:
    return s.b_assess.select("assess_id", F.round(fuse.memory_score(F.col("support"), F.col("uncertainty"), F.col("exploitability")), 6).alias("score"))


@query("f07_semantic_score", "SELECT fn, round(CASE WHEN mx IS NULL THEN greatest(0.15, av * 0.5) ELSE 0.5 + mx * 0.45 END, 6) AS score FROM (SELECT fn, max(CASE WHEN conf_pct >= 60 THEN conf_pct END) / 100 AS mx, sum(conf_pct) / count(*) / 100 AS av FROM b_sem WHERE conf_pct >= 40 GROUP BY fn) t")
def f07(s: Source) -> DataFrame:
    return fuse.semantic_by_function(s.b_sem).select("fn", F.round(fuse.semantic_score(F.col("n_sem"), F.col("sem_max"), F.col("sem_avg")), 6).alias("score"))


@query("f08_posterior", "SELECT cand_id, round(CASE WHEN e * p + (1 - e) * (1 - p) < 1e-9 THEN p ELSE e * p / (e * p + (1 - e) * (1 - p)) END, 6) AS posterior FROM (SELECT cand_id, conf_pct / 100 AS p, (cand_id % 11) / 10 AS e FROM b_candidates) t")
def f08(s: Source) -> DataFrame:
    return s.b_candidates.select("cand_id", F.round(fuse.posterior(F.col("conf_pct") / 100, F.col("cand_id") % 11 / 10), 6).alias("posterior"))


@query("f15_learning_counts", "SELECT analysis_type, count(*) AS n FROM b_sem s WHERE conf_pct >= 60 AND fn IN (SELECT fn FROM b_assess WHERE support IN ('Strong', 'Moderate') AND exploitability IN ('High', 'Medium') AND uncertainty <> 'High') GROUP BY analysis_type")
def f15(s: Source) -> DataFrame:
    ok = s.b_assess.filter(fuse.confirmed(F.col("support"), F.col("exploitability"), F.col("uncertainty"))).select("fn").distinct()
    return s.b_sem.filter(F.col("conf_pct") >= fuse.SEMANTIC_CONFIRMED * 100).join(ok, "fn", "left_semi").groupBy("analysis_type").agg(F.count("*").alias("n"))


@query("f16_semantic_thresholds", "SELECT sem_id, conf_pct >= 60 AS confirmed FROM b_sem WHERE conf_pct >= 40")
def f16(s: Source) -> DataFrame:
    return s.b_sem.filter(F.col("conf_pct") >= fuse.SEMANTIC_KEPT * 100).select("sem_id", (F.col("conf_pct") >= fuse.SEMANTIC_CONFIRMED * 100).alias("confirmed"))


@query("f18_logic_findings", "SELECT sem_id, 'logic:' || analysis_type AS vuln_type, 'LOGIC' AS sink_fn, CASE WHEN conf_pct >= 80 THEN 'high' ELSE 'medium' END AS severity FROM b_sem WHERE conf_pct >= 60")
def f18(s: Source) -> DataFrame:
    found = s.b_sem.filter("conf_pct >= 60")
    return found.select("sem_id", F.concat(F.lit("logic:"), F.col("analysis_type")).alias("vuln_type"), F.lit("LOGIC").alias("sink_fn"), F.when(F.col("conf_pct") >= 80, "high").otherwise("medium").alias("severity"))
