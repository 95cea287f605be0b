"""Queries over operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.dims import OP_GROUPS, TAINT_SINKS, TAINT_SOURCES
from ..operators import ops
from .base import Source, query

_ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w.lower()}')" for w in words) + ")"


def _ops(s: Source) -> DataFrame:
    return ops.of_bridge(s.b_ops)


@query("s03_op_denylist", "SELECT fn, op, event_id, CAST(row_number() OVER (PARTITION BY fn ORDER BY seq) - 1 AS INTEGER) AS seq FROM b_ops WHERE op NOT IN ('COPY', 'INT_ZEXT')")
def s03(s: Source) -> DataFrame:
    return ops.without_skipped(s.b_ops, ["COPY", "INT_ZEXT"]).select("fn", "op", "event_id", "seq")


@query("w01_first_occurrence_numbers", """
SELECT fn, var, CAST(row_number() OVER (PARTITION BY fn ORDER BY at_seq, at_slot, var) - 1 AS INTEGER) AS number FROM (
  SELECT fn, var, min(seq * 10 + slot) // 10 AS at_seq, min(seq * 10 + slot) % 10 AS at_slot FROM (
    SELECT fn, seq, 0 AS slot, in1 AS var FROM b_ops UNION ALL SELECT fn, seq, 1, in2 FROM b_ops UNION ALL SELECT fn, seq, 5, out_var FROM b_ops WHERE out_var IS NOT NULL) u
  WHERE NOT starts_with(var, 'const') GROUP BY fn, var) f""")
def w01(s: Source) -> DataFrame:
    return ops.first_occurrences(_ops(s))


@query("p04_function_flags", f"""
SELECT fn, bool_or(op = 'LOAD') AS has_load, bool_or(op = 'STORE') AS has_store, bool_or(op = 'CBRANCH') AS has_loop, bool_or(op = 'CALLIND') AS has_indirect_call,
  bool_or(op IN ('INT_ADD', 'INT_SUB', 'INT_MULT', 'INT_DIV')) AS has_int_arith, bool_or(op IN ('PTRADD', 'PTRSUB')) AS has_pointer_arith,
  coalesce(bool_or({_ANY("lower(callee)", [*TAINT_SOURCES, *TAINT_SINKS])}), false) AS calls_dangerous_import,
  bool_or(op IN ('LOAD', 'STORE')) AND bool_or(op IN ('CALL', 'CALLIND')) AS has_mem_and_call FROM b_ops GROUP BY fn""")
def p04(s: Source) -> DataFrame:
    return ops.flags(_ops(s), [*TAINT_SOURCES, *TAINT_SINKS])


@query("p05_size_filter", "SELECT fn, count(*) AS n FROM b_ops GROUP BY fn HAVING count(*) BETWEEN 60 AND 70")
def p05(s: Source) -> DataFrame:
    return s.b_ops.groupBy("fn").agg(F.count("*").alias("n")).filter("n BETWEEN 60 AND 70")


@query("p06_constant_parse", "SELECT event_id, CAST(nullif(regexp_extract(in2, '^const\\(([0-9]+)\\)$', 1), '') AS BIGINT) AS value FROM b_ops")
def p06(s: Source) -> DataFrame:
    return s.b_ops.select("event_id", names.constant(F.col("in2")).cast("long").alias("value"))


@query("p08_shift_amount", "SELECT event_id, k % 64 AS shift FROM b_ops WHERE op = 'INT_ADD'")
def p08(s: Source) -> DataFrame:
    hexed = F.concat(F.lit("const(0x"), F.lower(F.hex(F.col("k") % 64)), F.lit(")"))
    return s.b_ops.filter("op = 'INT_ADD'").select("event_id", names.constant(hexed).cast("int").alias("shift"))


@query("p09_name_cleanup", """
SELECT DISTINCT callee, CASE WHEN op = 'CALLIND' THEN 'INDIRECT:unknown' ELSE callee END AS cleaned FROM b_ops WHERE callee IS NOT NULL OR op = 'CALLIND'""")
def p09(s: Source) -> DataFrame:
    dressed = F.concat(F.lit("<"), F.col("callee"), F.lit("@plt>"))
    return s.b_ops.filter("callee IS NOT NULL OR op = 'CALLIND'").select("callee", names.clean_name(F.coalesce(dressed, F.lit("<>")), F.col("op") == "CALLIND").alias("cleaned")).distinct()


@query("p10_callee_cleanup", """
SELECT DISTINCT callee, lower(callee) AS a, lower(callee) AS b, callee AS c, lower(callee) AS d, callee AS e FROM b_ops WHERE callee IS NOT NULL""")
def p10(s: Source) -> DataFrame:
    plt, scoped = F.concat(F.lit("<"), F.col("callee"), F.lit("@plt>")), F.concat(F.lit("ns::cls::"), F.col("callee"), F.lit("(int, char*)"))
    return s.b_ops.filter("callee IS NOT NULL").select(
        "callee", names.callee_lower(plt).alias("a"), names.callee_before_at(plt).alias("b"), names.callee_before_at(plt, lower=False).alias("c"), names.last_scope(scoped).alias("d"), names.last_scope(scoped, lower=False).alias("e")
    ).distinct()


@query("p11_address_normalise", """
SELECT p_partkey, CASE WHEN p_partkey % 16 = 0 AND p_partkey < 16 THEN '0' ELSE lower(hex(p_partkey)) END AS call_form, lower(hex(p_partkey)) AS entry_form FROM part""")
def p11(s: Source) -> DataFrame:
    h = F.hex("p_partkey")
    return s.part.select("p_partkey", names.address(F.concat(F.lit("ram(0x000"), h, F.lit(")"))).alias("call_form"), names.entry_address(F.concat(F.lit("0000"), h)).alias("entry_form"))


@query("p12_raw_address", "SELECT event_id, event_id % 3 <> 0 AS raw FROM events")
def p12(s: Source) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, "recv").when(F.col("event_id") % 3 == 1, "0x10").otherwise("INDIRECT:VAR_1")
    return s.events.select("event_id", names.raw_address(name).alias("raw"))


@query("p13_op_routing", """
SELECT CASE WHEN op IN ('CALL', 'CALLIND') THEN 'call' WHEN op = 'STORE' THEN 'store' WHEN op = 'LOAD' THEN 'load' WHEN op = 'CBRANCH' THEN 'cbranch'
  WHEN op = 'RETURN' THEN 'branch' ELSE 'arith' END AS route, count(*) AS n FROM b_ops GROUP BY 1""")
def p13(s: Source) -> DataFrame:
    return s.b_ops.groupBy(names.op_route(F.col("op")).alias("route")).agg(F.count("*").alias("n"))


_GROUP_CASE = "CASE " + " ".join(f"WHEN op IN ({', '.join(repr(o) for o in v.split())}) THEN '{k}'" for k, v in OP_GROUPS.items()) + " ELSE 'other' END"


@query("p14_op_groups", f"SELECT fn, {_GROUP_CASE} AS op_group, count(*) AS n FROM b_ops GROUP BY 1, 2")
def p14(s: Source) -> DataFrame:
    return s.b_ops.groupBy("fn", names.op_group(F.col("op")).alias("op_group")).agg(F.count("*").alias("n"))


@query("a01_op_histogram", "SELECT fn, op, count(*) AS n FROM b_ops GROUP BY fn, op")
def a01(s: Source) -> DataFrame:
    return ops.histogram(s.b_ops)


@query("a02_function_features", f"""
SELECT fn, count(*) AS instructions, count_if(op = 'CBRANCH') + 1 AS cyclomatic, count_if(op = 'CBRANCH') + 1 AS blocks, count_if(op = 'LOAD') AS loads, count_if(op = 'STORE') AS stores,
  count_if(op = 'INT_MULT') AS mults, count_if(op = 'INT_ADD') AS adds, CAST(0 AS BIGINT) AS shifts, count_if(op IN ('PTRADD', 'PTRSUB')) AS pointers, count_if(op = 'INT_ZEXT') AS casts,
  count_if(op = 'CBRANCH') AS cbranches, count_if(op = 'INT_LESS') AS compares, count_if(op IN ('CALL', 'CALLIND')) AS calls, count_if(op = 'CALLIND') AS indirect_calls,
  coalesce(array_to_string(list_sort(list(DISTINCT callee) FILTER (WHERE {_ANY("lower(callee)", TAINT_SOURCES)})), ','), '') AS input_calls,
  coalesce(array_to_string(list_sort(list(DISTINCT callee) FILTER (WHERE {_ANY("lower(callee)", TAINT_SINKS)})), ','), '') AS sink_calls,
  coalesce(bool_or(contains(lower(callee), 'alloc')), false) AS heap_alloc FROM b_ops GROUP BY fn""")
def a02(s: Source) -> DataFrame:
    f = ops.features(_ops(s))
    return f.withColumn("input_calls", F.array_join("input_calls", ",")).withColumn("sink_calls", F.array_join("sink_calls", ","))


@query("a03_unchecked_arith_store", """
WITH u AS (SELECT fn, seq, op, in1 AS var FROM b_ops UNION ALL SELECT fn, seq, op, in2 FROM b_ops),
a AS (SELECT fn, out_var AS var, min(seq) AS made FROM b_ops WHERE op IN ('INT_ADD', 'INT_SUB', 'INT_MULT') GROUP BY 1, 2),
hit AS (SELECT DISTINCT s.fn FROM u s JOIN a ON a.fn = s.fn AND a.var = s.var AND s.seq > a.made
  WHERE s.op = 'STORE' AND NOT EXISTS (SELECT 1 FROM u c WHERE c.op = 'CBRANCH' AND c.fn = s.fn AND c.var = s.var AND c.seq <= s.seq))
SELECT fn, fn IN (SELECT fn FROM hit) AS unchecked FROM (SELECT DISTINCT fn FROM b_ops) f""")
def a03(s: Source) -> DataFrame:
    return ops.unchecked_stores(_ops(s))


@query("a04_semantic_risk_counters", """
WITH l AS (SELECT *, lag(op) OVER (PARTITION BY fn ORDER BY seq) AS prev, coalesce(contains(lower(callee), 'alloc'), false) AS al FROM b_ops)
SELECT fn, count_if(op = 'INT_MULT') AS mults, CAST(0 AS BIGINT) AS shifts, count_if(op = 'CBRANCH') AS cbranches, count_if(op = 'STORE') AS stores,
  count_if(op = 'STORE' AND coalesce(prev IN ('INT_ADD', 'INT_SUB', 'INT_MULT', 'PTRADD', 'PTRSUB'), false)) AS arith_stores, count_if(al) AS allocs, arg_min(callee, seq) FILTER (WHERE al) AS allocator
FROM l GROUP BY fn""")
def a04(s: Source) -> DataFrame:
    return ops.risk_counters(_ops(s))


@query("a05_ordered_hash", "SELECT fn, sha256(string_agg(op, ' ' ORDER BY seq))[1:16] AS fingerprint FROM b_ops GROUP BY fn")
def a05(s: Source) -> DataFrame:
    return ops.ordered_hash(s.b_ops, F.col("op"))


@query("a05b_ordered_hash_with_size", "SELECT fn, sha256(string_agg(op || ':' || CAST(in_size AS VARCHAR), ' ' ORDER BY seq))[1:16] AS fingerprint FROM b_ops GROUP BY fn")
def a05b(s: Source) -> DataFrame:
    return ops.ordered_hash(s.b_ops, F.concat_ws(":", "op", F.col("in_size").cast("string")))


_KNOWN = ["malloc", "free", "memcpy", "fread", "recv", "read", "strcpy", "system"]
_SIG = "coalesce(string_agg(DISTINCT callee, ',' ORDER BY callee) FILTER (WHERE callee IN (" + ", ".join(repr(k) for k in _KNOWN) + ")), '')"


@query("a06_call_signature", f"SELECT fn, {_SIG} AS signature FROM b_ops GROUP BY fn")
def a06(s: Source) -> DataFrame:
    return ops.call_signature(_ops(s), _KNOWN)


_SHARE = lambda g: f"count_if({_GROUP_CASE} = '{g}')"
_VECTOR = ", ".join([*(f"round({_SHARE(g)} / count(*), 6)" for g in sorted(OP_GROUPS)), "0.0::DOUBLE", *(f"CASE WHEN {_SHARE(g)} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for g in ("call", "indirect_call")), f"round(least(1.0, {_SHARE('branch')} / count(*) * 10), 6)", "round(least(1.0, count_if(op = 'LOAD') / count(*) * 5), 6)", "round(least(1.0, count_if(op = 'STORE') / count(*) * 5), 6)"])


@query("a07_group_vector", f"SELECT fn, CAST(dim AS INTEGER) AS dim, v FROM (SELECT fn, unnest(range(0, 20)) AS dim, unnest([{_VECTOR}]) AS v FROM b_ops GROUP BY fn) t")
def a07(s: Source) -> DataFrame:
    return ops.group_vector(_ops(s)).select("fn", F.posexplode("vector").alias("dim", "v"))


@query("a08_structural_role", f"""
SELECT fn, CASE WHEN contains(sig, 'malloc') THEN 'allocator' WHEN contains(sig, 'free') THEN 'free' WHEN contains(sig, 'memcpy') THEN 'copy' WHEN contains(sig, 'fread') OR contains(sig, 'recv') OR contains(sig, 'read') THEN 'read_input'
  WHEN c AND b AND NOT st THEN 'validator' ELSE 'unknown' END AS role
FROM (SELECT fn, {_SIG} AS sig, bool_or(op = 'STORE') AS st, bool_or(op IN ('INT_LESS', 'INT_EQUAL')) AS c, bool_or(op = 'CBRANCH') AS b FROM b_ops GROUP BY fn) t""")
def a08(s: Source) -> DataFrame:
    return ops.structural_role(_ops(s), _KNOWN)


@query("j09_exact_fingerprint", f"""
WITH k AS (SELECT fn, sha256(array_to_string([{", ".join(f"'{g}:' || CAST({_SHARE(g)} AS VARCHAR)" for g in sorted(OP_GROUPS))}], ',') || '|' || {_SIG} || '|ptrs=0')[1:16] AS skey FROM b_ops GROUP BY fn)
SELECT skey, count(*) AS n, min(fn) AS first FROM k GROUP BY skey HAVING count(*) > 1""")
def j09(s: Source) -> DataFrame:
    keys = ops.structural_key(_ops(s), _KNOWN)
    return keys.groupBy("skey").agg(F.count("*").alias("n"), F.min("fn").alias("first")).filter("n > 1")


@query("p17_structural_role", """
SELECT fn, CASE WHEN l <= 2 AND st <= 2 AND c <= 3 AND m = 0 AND b <= 3 THEN 'error_handler' WHEN b >= 3 AND ls >= 2 AND st * 20 < n THEN 'validator' WHEN b >= 4 AND l >= 5 AND c >= 2 THEN 'parser'
  WHEN m + a >= 10 AND l <= 3 AND c <= 2 THEN 'math' WHEN h AND c <= 4 THEN 'allocator' ELSE 'unknown' END AS role,
  CASE WHEN l <= 2 AND st <= 2 AND c <= 3 AND m = 0 AND b <= 3 THEN 0.4::DOUBLE WHEN b >= 3 AND ls >= 2 AND st * 20 < n THEN 0.55::DOUBLE WHEN b >= 4 AND l >= 5 AND c >= 2 THEN 0.5::DOUBLE
  WHEN m + a >= 10 AND l <= 3 AND c <= 2 THEN 0.45::DOUBLE WHEN h AND c <= 4 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS role_conf
FROM (SELECT fn, count(*) AS n, count_if(op = 'LOAD') AS l, count_if(op = 'STORE') AS st, count_if(op IN ('CALL', 'CALLIND')) AS c, count_if(op = 'INT_MULT') AS m, count_if(op = 'INT_ADD') AS a, count_if(op = 'CBRANCH') AS b,
  count_if(op = 'INT_LESS') AS ls, coalesce(bool_or(contains(lower(callee), 'alloc')), false) AS h FROM b_ops GROUP BY fn) t""")
def p17(s: Source) -> DataFrame:
    return ops.counter_role(ops.features(_ops(s)))


@query("w02_parameters", """
WITH u AS (SELECT fn, in1 AS var, seq * 10 AS pos FROM b_ops UNION ALL SELECT fn, in2, seq * 10 + 1 FROM b_ops)
SELECT fn, var, CAST(row_number() OVER (PARTITION BY fn ORDER BY pos, var) - 1 AS INTEGER) AS position FROM (
  SELECT fn, var, min(pos) AS pos FROM u WHERE var LIKE 'VAR\\_%' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM b_ops d WHERE d.fn = u.fn AND d.out_var = u.var) GROUP BY fn, var) t""")
def w02(s: Source) -> DataFrame:
    return ops.parameters(_ops(s))


@query("w02c_parameters_before_call", """
WITH u AS (SELECT fn, in1 AS var, seq, 0 AS slot, in_size FROM b_ops UNION ALL SELECT fn, in2, seq, 1, in_size FROM b_ops),
c AS (SELECT fn, min(seq) AS s FROM b_ops WHERE op IN ('CALL', 'CALLIND') GROUP BY fn)
SELECT t.fn, var, CAST(row_number() OVER (PARTITION BY t.fn ORDER BY pos, var) - 1 AS INTEGER) AS position FROM (
  SELECT fn, var, min(seq * 10 + slot) AS pos FROM u WHERE in_size = 8 AND var LIKE 'VAR\\_%' ESCAPE '\\' GROUP BY fn, var) t LEFT JOIN c ON c.fn = t.fn WHERE c.s IS NULL OR pos // 10 < c.s""")
def w02c(s: Source) -> DataFrame:
    return ops.parameters(_ops(s), sizes=(8,), before_first_call=True)


@query("w07_late_null_check", """
SELECT fn, seq, late AS checked_late FROM (SELECT fn, seq, op, coalesce(bool_or(op IN ('INT_EQUAL', 'INT_NOTEQUAL')) OVER (PARTITION BY fn ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), false) AS late FROM b_ops) t WHERE op = 'CALLIND'""")
def w07(s: Source) -> DataFrame:
    return ops.late_null_checks(s.b_ops)


@query("j17_range_join", "SELECT a.fn, a.seq, b.seq AS check_seq FROM b_ops a JOIN b_ops b ON a.fn = b.fn AND b.seq BETWEEN a.seq + 1 AND a.seq + 12 WHERE a.op = 'CALLIND' AND b.op = 'INT_EQUAL'")
def j17(s: Source) -> DataFrame:
    near = ops.context(s.b_ops, s.b_ops.filter("op = 'CALLIND'").select("fn", F.col("seq").alias("at")), 12)
    return near.filter("op = 'INT_EQUAL' AND seq > at").select("fn", F.col("at").alias("seq"), F.col("seq").alias("check_seq"))


@query("j18_chained_loads", """
WITH n AS (SELECT *, lead(op) OVER w AS op2, lead(out_var) OVER w AS var2, lead(in1) OVER w AS i1, lead(in2) OVER w AS i2 FROM b_ops WINDOW w AS (PARTITION BY fn ORDER BY seq)),
c AS (SELECT fn, seq, in1 AS var FROM b_ops WHERE op IN ('INT_EQUAL', 'INT_NOTEQUAL') UNION SELECT fn, seq, in2 FROM b_ops WHERE op IN ('INT_EQUAL', 'INT_NOTEQUAL'))
SELECT fn, seq, out_var AS first_var, var2 AS second_var FROM n WHERE op = 'LOAD' AND op2 = 'LOAD' AND out_var IN (i1, i2)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.fn = n.fn AND c.var = n.out_var AND c.seq < n.seq)
  AND EXISTS (SELECT 1 FROM c WHERE c.fn = n.fn AND c.var = n.var2 AND c.seq BETWEEN n.seq + 2 AND n.seq + 4)""")
def j18(s: Source) -> DataFrame:
    return ops.chained_loads(_ops(s))


@query("w09_previous_op", "SELECT fn, seq, lag(op) OVER (PARTITION BY fn ORDER BY seq) AS prev FROM b_ops")
def w09(s: Source) -> DataFrame:
    return s.b_ops.select("fn", "seq", F.lag("op").over(ops.by_seq()).alias("prev"))


@query("w10_context_frames", "SELECT a.fn, a.seq AS at, b.seq, b.op FROM b_ops a JOIN b_ops b ON a.fn = b.fn AND abs(b.seq - a.seq) <= 2 WHERE a.op = 'STORE'")
def w10(s: Source) -> DataFrame:
    return ops.context(s.b_ops, s.b_ops.filter("op = 'STORE'").select("fn", F.col("seq").alias("at")), 2)


@query("w11_last_return", "SELECT fn, max(seq) AS seq, arg_max(in1, seq) AS var FROM b_ops WHERE op = 'RETURN' GROUP BY fn")
def w11(s: Source) -> DataFrame:
    return ops.last_return(_ops(s))


@query("j08_def_use", """
WITH u AS (SELECT fn, seq, op, in1 AS var FROM b_ops UNION SELECT fn, seq, op, in2 FROM b_ops)
SELECT u.fn, u.seq, u.op, u.var, d.seq AS def_seq, d.op AS def_op FROM u JOIN b_ops d ON d.fn = u.fn AND d.out_var = u.var""")
def j08(s: Source) -> DataFrame:
    return ops.def_use(_ops(s))


@query("p15_discard", """
SELECT fn, CASE WHEN n < 5 THEN 'too_few_ops' WHEN m = 0 AND c = 0 AND b = 0 THEN 'pure_computation_no_memory' ELSE '' END AS reason
FROM (SELECT fn, count(*) AS n, count_if(op IN ('LOAD', 'STORE')) AS m, count_if(op IN ('CALL', 'CALLIND')) AS c, count_if(op = 'CBRANCH') AS b FROM b_ops GROUP BY fn) t""")
def p15(s: Source) -> DataFrame:
    f = ops.features(_ops(s))
    pure = (F.col("loads") + F.col("stores") == 0) & (F.col("calls") == 0) & (F.col("cbranches") == 0)
    return f.select("fn", F.when(F.col("instructions") < 5, "too_few_ops").when(pure, "pure_computation_no_memory").otherwise("").alias("reason"))
