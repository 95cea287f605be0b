"""Queries over call graphs and data flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import contains_any
from ..operators import graph, match, ops, vectors
from .base import Source, query

_N = "(SELECT caller AS node FROM b_graph UNION SELECT callee FROM b_graph)"
_FLOW = """f AS (SELECT fn, in1 AS src, out_var AS dst FROM b_ops WHERE op NOT IN ('CALL') AND out_var IS NOT NULL AND NOT starts_with(in1, 'const') UNION SELECT fn, in2, out_var FROM b_ops WHERE op NOT IN ('CALL') AND out_var IS NOT NULL AND NOT starts_with(in2, 'const'))"""
_SEED = "s AS (SELECT DISTINCT fn, out_var AS var FROM b_ops WHERE op = 'CALL' AND callee IN ('recv', 'fread', 'getenv', 'fgets'))"


def _flow(s: Source) -> DataFrame:
    rows = ops.of_bridge(s.b_ops).filter("op != 'CALL' AND out_var IS NOT NULL")
    return rows.select("fn", F.explode("args").alias("src"), F.col("out_var").alias("dst")).filter("NOT src LIKE 'const%'")


def _seeds(s: Source) -> DataFrame:
    return s.b_ops.filter("op = 'CALL' AND callee IN ('recv', 'fread', 'getenv', 'fgets')").select("fn", F.col("out_var").alias("var")).distinct()


def _some(spark_nodes: DataFrame, k: int) -> DataFrame:
    return spark_nodes.filter(F.substring_index("node", "_", -1).cast("int") % k == 0)


@query("g01_call_graph", "SELECT DISTINCT fn AS caller, callee FROM b_ops WHERE callee IS NOT NULL")
def g01(s: Source) -> DataFrame:
    b = s.b_ops.filter("callee IS NOT NULL")
    sites = b.filter("seq % 2 = 0").select(F.col("fn").alias("caller"), "callee")
    calls = b.filter("seq % 2 = 1").select(F.col("fn").alias("caller"), F.col("callee").alias("target"))
    return graph.call_graph(sites, calls, b.select("fn", F.lit("0x0").alias("entry_addr")).distinct())


@query("g02_internal_edges", "SELECT caller, callee FROM b_edges WHERE callee IN (SELECT fn FROM b_ops)")
def g02(s: Source) -> DataFrame:
    return match.internal_edges(s.b_edges, s.b_ops.select("fn").distinct()).select("caller", "callee")


@query("g03_levels", """
WITH RECURSIVE e AS (SELECT DISTINCT least(caller, callee) AS caller, greatest(caller, callee) AS callee FROM b_graph WHERE caller <> callee),
d AS (SELECT node, 0 AS depth FROM (SELECT caller AS node FROM e UNION SELECT callee FROM e) n WHERE node NOT IN (SELECT caller FROM e)
  UNION SELECT e.caller, d.depth + 1 FROM d JOIN e ON e.callee = d.node)
SELECT node, CAST(max(depth) AS INTEGER) AS level FROM d GROUP BY node""")
def g03(s: Source) -> DataFrame:
    # Every edge turned to the later name, so that none closes a cycle.
    turned = s.b_graph.filter("caller != callee").select(F.least("caller", "callee").alias("caller"), F.greatest("caller", "callee").alias("callee"))
    return graph.levels(turned.distinct())


@query("g04_reaches_dangerous", f"""
WITH t AS (SELECT node FROM {_N} n WHERE contains(node, '7')), a AS (SELECT DISTINCT caller AS node FROM b_graph WHERE callee IN (SELECT node FROM t)),
b AS (SELECT node FROM a UNION SELECT caller FROM b_graph WHERE callee IN (SELECT node FROM a)), c AS (SELECT node FROM b UNION SELECT caller FROM b_graph WHERE callee IN (SELECT node FROM b)) SELECT node FROM c""")
def g04(s: Source) -> DataFrame:
    return graph.reaches_within(s.b_graph, contains_any(F.col("node"), ["7"]), 3)


@query("g05_source_distance", f"""
WITH RECURSIVE d AS (SELECT node, 0 AS dist FROM {_N} n WHERE node IN ('fn_3', 'fn_11') UNION SELECT g.caller, d.dist + 1 FROM d JOIN b_graph g ON g.callee = d.node WHERE d.dist < 4)
SELECT n.node, CAST(coalesce(min(dist), 5) AS INTEGER) AS dist FROM {_N} n LEFT JOIN d ON d.node = n.node GROUP BY n.node""")
def g05(s: Source) -> DataFrame:
    return graph.source_distance(s.b_graph, F.col("node").isin("fn_3", "fn_11"))


@query("g06_reachability", f"""
WITH RECURSIVE d AS (SELECT 'fn_5' AS node UNION SELECT g.caller FROM d JOIN b_graph g ON g.callee = d.node)
SELECT node FROM {_N} n WHERE CASE WHEN (SELECT count(*) FROM d) >= 0.05 * (SELECT count(*) FROM {_N} m) THEN node IN (SELECT node FROM d) ELSE NOT contains(node, '9') END""")
def g06(s: Source) -> DataFrame:
    return graph.reachable(s.b_graph, F.col("node") == "fn_5", contains_any(F.col("node"), ["9"]))


def _ppr(rounds: int) -> str:
    parts = [f"n AS {_N[1:-1].join(['(', ')'])}", "c AS (SELECT callee, count(*) AS k FROM b_graph GROUP BY callee)", "p AS (SELECT node, CASE WHEN CAST(split_part(node, '_', 2) AS INT) % 10 = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM n WHERE CAST(split_part(node, '_', 2) AS INT) % 10 = 0) ELSE 0.0::DOUBLE END AS w FROM n)", "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT p.node, 0.85 * coalesce(sum(q.r / c.k), 0) + 0.15 * any_value(p.w) AS r FROM p LEFT JOIN b_graph g ON g.caller = p.node LEFT JOIN r{i - 1} q ON q.node = g.callee LEFT JOIN c ON c.callee = g.callee GROUP BY p.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(r / (SELECT max(r) FROM r{rounds}), 4) AS rank FROM r{rounds}"


@query("g07_personalised_pagerank", _ppr(25))
def g07(s: Source) -> DataFrame:
    some = _some(graph.nodes(s.b_graph), 10)
    n = some.count()
    return graph.page_rank(s.b_graph, some.withColumn("weight", F.lit(1.0 / max(n, 1))))


@query("g07b_fan_in_rank", f"SELECT n.node, round(coalesce(k, 0) / (SELECT max(k) FROM (SELECT count(*) AS k FROM b_graph GROUP BY callee) m), 4) AS rank FROM {_N} n LEFT JOIN (SELECT callee, count(*) AS k FROM b_graph GROUP BY callee) c ON c.callee = n.node")
def g07b(s: Source) -> DataFrame:
    return graph.page_rank(s.b_graph, None)


@query("a09_degrees", f"SELECT n.node, (SELECT count(*) FROM b_graph g WHERE g.callee = n.node) AS fan_in, (SELECT count(*) FROM b_graph g WHERE g.caller = n.node) AS fan_out FROM {_N} n")
def a09(s: Source) -> DataFrame:
    return graph.degrees(s.b_graph)


def _g08() -> str:
    step = lambda a, b: f"{b} AS MATERIALIZED (SELECT x.node, round((x.score + least(coalesce((SELECT sum(y.score) FROM b_graph g JOIN {a} y ON y.node = g.callee WHERE g.caller = x.node), 0) * 0.15, CASE WHEN x.ops > 500 THEN 2.0 ELSE 999.0 END) + coalesce((SELECT sum(y.score) FROM b_graph g JOIN {a} y ON y.node = g.caller WHERE g.callee = x.node), 0) * 0.10)::DECIMAL(18, 9), 4)::DOUBLE AS score, x.ops FROM {a} x)"
    return f"WITH s0 AS (SELECT node, (CAST(split_part(node, '_', 2) AS INT) % 8)::DOUBLE / 4 AS score, CAST(split_part(node, '_', 2) AS INT) * 10 AS ops FROM {_N} n), {step('s0', 's1')}, {step('s1', 's2')} SELECT node, score FROM s2"


@query("g08_score_propagation", _g08())
def g08(s: Source) -> DataFrame:
    k = F.substring_index("node", "_", -1).cast("int")
    return graph.propagate_scores(graph.nodes(s.b_graph).select("node", ((k % 8) / 4.0).alias("score"), (k * 10).alias("ops")), s.b_graph)


@query("g09_neighbourhood", f"""
WITH sc AS (SELECT node, (CAST(split_part(node, '_', 2) AS INT) % 10)::DOUBLE / 10 AS score FROM {_N} n), sd AS (SELECT 'fn_1' AS node),
u1 AS (SELECT DISTINCT caller AS node FROM b_graph WHERE callee IN (SELECT node FROM sd) EXCEPT SELECT node FROM sd),
u2 AS (SELECT DISTINCT caller AS node FROM b_graph WHERE callee IN (SELECT node FROM u1) EXCEPT (SELECT node FROM sd UNION SELECT node FROM u1)),
dn AS (SELECT g.callee AS node, 1 AS hop FROM b_graph g JOIN sc ON sc.node = g.callee AND score >= 0.3 WHERE g.caller IN (SELECT node FROM sd) UNION ALL SELECT g.callee, 2 FROM b_graph g JOIN sc ON sc.node = g.callee AND score >= 0.3 WHERE g.caller IN (SELECT node FROM u1)),
al AS (SELECT node, min(hop) AS hop FROM (SELECT node, 1 AS hop FROM u1 UNION ALL SELECT node, 2 FROM u2 UNION ALL SELECT node, hop FROM dn) t WHERE node NOT IN (SELECT node FROM sd) GROUP BY node)
SELECT al.node, CAST(hop AS INTEGER) AS hop FROM al JOIN sc ON sc.node = al.node ORDER BY hop, score DESC, al.node LIMIT 30""")
def g09(s: Source) -> DataFrame:
    scores = graph.nodes(s.b_graph).select("node", (F.substring_index("node", "_", -1).cast("int") % 10 / 10.0).alias("score"))
    return graph.neighbourhood(s.b_graph, s.spark.createDataFrame([("fn_1",)], "node string"), scores, 0.30, 2, 30)


@query("g16_neighbours", """
WITH b AS (SELECT caller AS x, callee AS y FROM b_graph UNION SELECT callee, caller FROM b_graph), h1 AS (SELECT DISTINCT y AS node FROM b WHERE x = 'fn_2' AND y <> 'fn_2'),
h2 AS (SELECT DISTINCT y AS node FROM b WHERE x IN (SELECT node FROM h1) AND y <> 'fn_2' AND y NOT IN (SELECT node FROM h1))
SELECT 'fn_2' AS node, 0 AS dist UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def g16(s: Source) -> DataFrame:
    return graph.neighbours(s.spark, s.b_graph, ["fn_2"])


@query("g17_tainted_closure", f"WITH RECURSIVE {_FLOW}, {_SEED}, t AS (SELECT fn, var FROM s UNION SELECT f.fn, f.dst FROM t JOIN f ON f.fn = t.fn AND f.src = t.var) SELECT fn, var FROM t")
def g17(s: Source) -> DataFrame:
    return graph.tainted(_flow(s), _seeds(s))


@query("g17b_tainted_sink_calls", f"""
WITH RECURSIVE {_FLOW}, {_SEED}, t AS (SELECT fn, var FROM s UNION SELECT f.fn, f.dst FROM t JOIN f ON f.fn = t.fn AND f.src = t.var)
SELECT b.fn, b.seq, b.callee FROM b_ops b WHERE op = 'CALL' AND callee IN ('memcpy', 'strcpy', 'system', 'malloc') AND EXISTS (SELECT 1 FROM t WHERE t.fn = b.fn AND t.var IN (b.in1, b.in2))""")
def g17b(s: Source) -> DataFrame:
    t = graph.tainted(_flow(s), _seeds(s))
    sinks = ops.uses(ops.of_bridge(s.b_ops).filter("op = 'CALL' AND callee IN ('memcpy', 'strcpy', 'system', 'malloc')"))
    hit = sinks.join(t, ["fn", "var"], "left_semi").select("fn", "seq").distinct()
    return s.b_ops.join(hit, ["fn", "seq"]).select("fn", "seq", "callee")


@query("g15_backward_slice", f"""
WITH RECURSIVE {_FLOW}, g AS (SELECT DISTINCT fn, in1 AS target FROM b_ops WHERE op = 'STORE'),
d AS (SELECT fn, target, target AS var, 0 AS depth FROM g UNION SELECT d.fn, d.target, f.src, d.depth + 1 FROM d JOIN f ON f.fn = d.fn AND f.dst = d.var WHERE d.depth < 20)
SELECT fn, target, var, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY fn, target, var""")
def g15(s: Source) -> DataFrame:
    targets = s.b_ops.filter("op = 'STORE'").select("fn", F.col("in1").alias("target")).distinct()
    return graph.backward_slice(_flow(s).distinct(), targets, 20)


@query("n2_longest_hops", f"WITH RECURSIVE {_FLOW}, {_SEED}, d AS (SELECT fn, var, 0 AS hops FROM s UNION SELECT f.fn, f.dst, d.hops + 1 FROM d JOIN f ON f.fn = d.fn AND f.src = d.var) SELECT fn, var, CAST(max(hops) AS INTEGER) AS hops FROM d GROUP BY fn, var")
def n2(s: Source) -> DataFrame:
    return graph.longest_hops(_flow(s), _seeds(s))


@query("g10_parameter_aliases", """
WITH RECURSIVE m AS (SELECT fn, in1 AS src, out_var AS dst FROM b_ops WHERE op IN ('COPY', 'INT_ZEXT', 'PTRADD', 'PTRSUB')),
a AS (SELECT DISTINCT fn, in1 AS var, CAST(right(in1, 1) AS INTEGER) AS position FROM b_ops WHERE in1 IN ('VAR_p0', 'VAR_p1') UNION SELECT m.fn, m.dst, a.position FROM a JOIN m ON m.fn = a.fn AND m.src = a.var)
SELECT fn, var, min(position) AS position FROM a GROUP BY fn, var""")
def g10(s: Source) -> DataFrame:
    moves = s.b_ops.filter("op IN ('COPY', 'INT_ZEXT', 'PTRADD', 'PTRSUB')").select("fn", F.col("in1").alias("src"), F.col("out_var").alias("dst"))
    params = s.b_ops.filter("in1 IN ('VAR_p0', 'VAR_p1')").select("fn", F.col("in1").alias("var"), F.right("in1", F.lit(1)).cast("int").alias("position")).distinct()
    return graph.aliases(moves, params)


@query("g14_external_functions", """
WITH RECURSIVE e AS (SELECT caller, callee FROM b_graph), d AS (SELECT 'fn_8' AS node, 0 AS dist UNION SELECT e.caller, d.dist + 1 FROM d JOIN e ON e.callee = d.node WHERE d.dist < 10)
SELECT node, CAST(min(dist) AS INTEGER) AS dist FROM d GROUP BY node""")
def g14(s: Source) -> DataFrame:
    return graph.external_functions(s.b_graph, s.spark.createDataFrame([("fn_8",)], "node string"))


@query("j10_nearest_vector", """
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS store_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT id, store_id, cos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, store_id) AS n FROM p WHERE cos >= 0.2) t WHERE n = 1""")
def j10(s: Source) -> DataFrame:
    e = s.embeddings.withColumn("v", F.col("embedding").cast("array<double>"))
    return vectors.search(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("v").alias("vector")), vectors.index(e.select(F.col("vec_id").alias("store_id"), F.col("v").alias("stored"))), 0.2)
