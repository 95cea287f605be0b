from __future__ import annotations

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binsift.operators import functionwise, graph, incremental, taint

OPS = "fn string, seq int, op string, callee string, out_var string, args array<string>, sizes array<int>"
RULES = taint.catalog()
COLUMNS = {"fn": pa.string(), "kind": pa.int32(), "seq": pa.int64(), "op": pa.string(), "callee": pa.string(), "out": pa.string(), "args": pa.list_(pa.string()), "sizes": pa.list_(pa.int32()), "x": pa.float64()}


def batch(rows):
    return pa.RecordBatch.from_pylist([dict.fromkeys(COLUMNS) | r for r in rows], schema=pa.schema(list(COLUMNS.items())))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=8), st.lists(st.integers(1, 5), max_size=20), st.one_of(st.none(), st.integers(1, 4)))
def test_functions_are_whole_however_batches_fall(functions, cuts, most):
    rows, wanted = [], []
    for k, (n, told) in enumerate(functions):
        name = None if k == 1 else f"f{k}"
        rows += [{"fn": name, "kind": functionwise.EFFECT, "seq": i, "op": "return", "callee": "g"} for i in range(told)]
        rows += [{"fn": name, "kind": functionwise.OPERATION, "seq": i, "op": "COPY", "out": f"V{i}", "args": ["V"], "sizes": [8]} for i in range(n)]
        if n and (most is None or n <= most):
            wanted.append((name, list(range(n)), [(i, "return") for i in range(told)]))
    batches, at = [], 0
    for c in [*cuts, len(rows)]:
        batches.append(batch(rows[at : at + c]))
        at += c
    got = [(fn, [o["seq"] for o in ops], facts.effects.get("g", [])) for fn, ops, facts in functionwise.one_by_one(iter(batches), most)]
    assert got == wanted


def test_operations_of_a_long_function_are_read_in_any_order(monkeypatch):
    monkeypatch.setattr(functionwise, "SLICE", 7)
    ops = functionwise.Operations()
    for lo, hi in ((0, 3), (3, 30), (30, 31), (31, 100)):
        ops.add(batch([{"fn": "f", "kind": functionwise.OPERATION, "seq": i, "op": "COPY"} for i in range(lo, hi)]))
    assert [o["seq"] for o in ops] == list(range(100)) == [ops[k]["seq"] for k in range(100)] and ops.short() is ops
    assert [o["seq"] for o in reversed(ops)] == list(range(99, -1, -1)) and ops[-1]["seq"] == 99
    order = random.Random(1).sample(range(100), 100)
    assert [ops[k]["seq"] for k in order] == order
    with pytest.raises(IndexError):
        ops[100]


def test_a_function_beyond_the_size_filter_is_walked_whole_if_asked(spark, monkeypatch):
    """20,000 moves from external data to a sink, over many batches."""
    n = 20_000
    moves = spark.range(n).select(F.lit("f").alias("fn"), (F.col("id") + 1).cast("int").alias("seq"), F.lit("COPY").alias("op"), F.lit(None).cast("string").alias("callee"), F.concat(F.lit("VAR_"), F.col("id") + 1).alias("out_var"), F.array(F.concat(F.lit("VAR_"), F.col("id"))).alias("args"), F.array(F.lit(8)).alias("sizes"))
    ends = spark.createDataFrame([("f", 0, "CALL", "recv", "VAR_0", ["VAR_s", "VAR_b"], [8, 8]), ("f", n + 1, "CALL", "system", None, [f"VAR_{n}"], [8])], OPS)
    flat = moves.unionByName(ends).repartition(5)
    assert taint.analyze(flat).count() == 0
    monkeypatch.setattr(taint, "MOST_OPS", None)
    row = taint.analyze(flat).first()
    assert {c.vuln_type for c in row.candidates} == {"command_injection"} and len(row.candidates[0].taint_path) == n + 1


@pytest.fixture
def one_task(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def reach_sets(edges):
    names = {x for e in edges for x in e}
    to = {n: {n} for n in names}
    for _ in names:
        for a, b in edges:
            to[a] |= to[b]
    return to


def plain_components(edges):
    to = reach_sets(edges)
    return {n: max(m for m in to if m in to[n] and n in to[m]) for n in to}


def test_strong_components_against_brute_force(spark, one_task):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("a", "b")]
    df = spark.createDataFrame(edges, "caller string, callee string")
    for small in (100_000, 3):
        assert {r.node: r.comp for r in graph.strong_components(df, small).collect()} == plain_components(edges)
    assert graph.strong_components(df.limit(0)).count() == 0
    assert {r.node: r.comp for r in graph.strong_components(spark.createDataFrame([("a", "b")], "caller string, callee string"), 0).collect()} == {"a": "a", "b": "b"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_strong_components_on_the_driver(pairs):
    edges = [(f"n{a}", f"n{b}") for a, b in pairs]
    assert graph._strong(edges) == plain_components(edges)


def copy(fn, seq, out, of):
    return (fn, seq, "COPY", None, out, [of], [8])


#: f, g and h call each other in a circle, and only h gives its argument back; top calls f, alone calls nobody, self itself.
RECURSIVE = [
    ("f", 0, "CALL", "g", "VAR_r", ["VAR_x"], [8]), ("f", 1, "RETURN", None, None, ["VAR_r"], [8]),
    ("g", 0, "CALL", "h", "VAR_r", ["VAR_x", "VAR_y"], [8, 8]), ("g", 1, "RETURN", None, None, ["VAR_r"], [8]),
    copy("h", 0, "VAR_c", "VAR_a"), ("h", 1, "CALL", "f", "VAR_q", ["VAR_b"], [8]), ("h", 2, "STORE", None, None, ["VAR_b", "VAR_q"], [8, 8]), ("h", 3, "RETURN", None, None, ["VAR_c"], [8]),
    ("top", 0, "CALL", "f", "VAR_r", ["VAR_p"], [8]), ("top", 1, "RETURN", None, None, ["VAR_r"], [8]),
    copy("alone", 0, "VAR_c", "VAR_a"), ("alone", 1, "RETURN", None, None, ["VAR_c"], [8]),
    ("self", 0, "CALL", "self", "VAR_r", ["VAR_b", "VAR_a"], [8, 8]), ("self", 1, "STORE", None, None, ["VAR_b", "VAR_r"], [8, 8]), copy("self", 2, "VAR_c", "VAR_a"), ("self", 3, "RETURN", None, None, ["VAR_c"], [8]),
]


def plain_fixpoint(rows):
    """Component by component, callees first: its members done again with what was found of all, from nothing, until
    nothing is new. A function outside of the component without effects is an unknown one."""
    of = {}
    for fn, seq, op, callee, out, args, sizes in rows:
        of.setdefault(fn, []).append({"seq": seq, "op": op, "callee": callee, "out": out, "args": args, "sizes": sizes})
    calls = [(fn, o["callee"]) for fn, p in of.items() for o in p if o["callee"] in of]
    comp = {fn: fn for fn in of} | plain_components(calls)
    known, left = {fn: set() for fn in of}, set(comp.values())
    while left:
        ready = sorted(c for c in left if not any(comp[a] == c and comp[b] != c and comp[b] in left for a, b in calls))
        for c in ready:
            mine = [fn for fn in of if comp[fn] == c]
            while True:
                told = {fn: sorted(e) for fn, e in known.items() if e} | {fn: [*sorted(known[fn]), (0, "nothing")] for fn in mine}
                found = {fn: set(taint.summary(sorted(of[fn], key=lambda o: o["seq"]), RULES, told)) for fn in mine}
                if all(found[fn] == known[fn] for fn in mine):
                    break
                known |= found
        left -= set(ready)
    return {(fn, *e) for fn, es in known.items() for e in es}


def effects_of(df):
    return {tuple(r) for r in df.select("fn", "arg", "effect").collect()}


def test_effects_through_recursion_are_the_fixpoint(spark, one_task):
    flat = spark.createDataFrame(RECURSIVE, OPS)
    got = effects_of(taint.summaries(flat))
    assert got == plain_fixpoint(RECURSIVE)
    assert {("h", 0, "return"), ("g", 0, "return"), ("f", 0, "return"), ("top", 0, "return"), ("h", 1, "mem:1"), ("self", 1, "return")} <= got and ("self", 0, "return") not in got
    place = {r.fn: (r.comp, r.level, r.cyclic) for r in taint.placed(taint.calls(flat), flat.select("fn").distinct()).collect()}
    assert place == {"f": ("h", 0, True), "g": ("h", 0, True), "h": ("h", 0, True), "top": ("top", 1, False), "alone": ("alone", 0, False), "self": ("self", 0, True)}


def program(n):
    """n functions in a tree of calls: function k calls 2k + 1 and 2k + 2; leaves read from outside or give back."""
    rows = []
    for k in range(n):
        fn = f"f{k:04d}"
        below = [c for c in (2 * k + 1, 2 * k + 2) if c < n]
        rows += [(fn, i, "CALL", f"f{c:04d}", f"VAR_{i}", ["VAR_a"], [8]) for i, c in enumerate(below)]
        rows += [(fn, 5, "COPY", None, "VAR_5", [f"VAR_{len(below) - 1}" if below else "VAR_a"], [8]), (fn, 6, "RETURN", None, None, ["VAR_5"], [8])]
        if not below and k % 3 == 0:
            rows += [(fn, 3, "CALL", "recv", "VAR_3", ["VAR_s", "VAR_b"], [8, 8]), (fn, 4, "CALL", "system", None, ["VAR_b"], [8])]
    return rows


def same(a, b):
    for name in ("effects", "passed", "external"):
        assert effects_like(getattr(a, name)) == effects_like(getattr(b, name)), name
    assert sorted(repr(r) for r in a.walked.collect()) == sorted(repr(r) for r in b.walked.collect())


def effects_like(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


def test_a_changed_leaf_of_a_thousand_functions_walks_its_callers_only(spark, one_task):
    rows = program(1000)
    first = incremental.run(spark.createDataFrame(rows, OPS))
    leaf = "f0998"
    changed = [r for r in rows if r[0] != leaf] + [(leaf, 0, "COPY", None, "VAR_c", ["VAR_x"], [8]), (leaf, 1, "RETURN", None, None, ["const(0x0)"], [8])]
    flat = spark.createDataFrame(changed, OPS)
    again = incremental.run(flat, first)
    above, k = {leaf}, 998
    while k:
        k = (k - 1) // 2
        above.add(f"f{k:04d}")
    assert {r.fn for r in again.done.collect()} == above and len(above) == 10
    same(again, incremental.run(flat))


def test_changes_of_marks_removed_and_new_functions(spark, one_task):
    rows = program(31)
    state = incremental.run(spark.createDataFrame(rows, OPS))
    # a source in a callee, a function that goes, a new one that calls an old one with external data
    changed = [r for r in rows if r[0] != "f0030"] + [
        ("f0016", 3, "CALL", "recv", "VAR_3", ["VAR_s", "VAR_b"], [8, 8]), ("new", 0, "CALL", "recv", "VAR_0", ["VAR_s", "VAR_b"], [8, 8]), ("new", 1, "CALL", "f0010", "VAR_1", ["VAR_b"], [8]),
    ]
    flat = spark.createDataFrame(changed, OPS)
    again = incremental.run(flat, state)
    same(again, incremental.run(flat))
    assert {r.fn for r in incremental.run(flat, again).done.collect()} == set()
    done = {r.fn for r in again.done.collect()}
    assert {"new", "f0016", "f0007", "f0003", "f0001", "f0000", "f0014", "f0006", "f0002"} <= done and "f0020" not in done and "f0030" not in done
