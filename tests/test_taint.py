from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binsift.operators import graph, ops, taint
from binsift.sources.records import FUNCTION

RULES = taint.catalog()


def op(seq, name, out=None, args=(), callee=None, sizes=None):
    return {"seq": seq, "op": name, "callee": callee, "out": out, "args": list(args), "sizes": list(sizes or [8] * len(args))}


def program(*rows):
    return [op(i, *r[:3], **(r[3] if len(r) > 3 else {})) for i, r in enumerate(rows)]


RECV = ("CALL", "V3", ("V1", "V2", "const(0x400)", "const(0x0)"), {"callee": "recv"})
SCENARIOS = {
    "recv_strcpy": (program(("LOAD", "V1", ("V0",)), RECV, ("CALL", None, ("Vl", "V2"), {"callee": "strcpy"})), {"buffer_overflow"}),
    "recv_strncpy": (program(RECV, ("CALL", None, ("Vd", "V2", "const(0x40)"), {"callee": "strncpy"})), set()),
    "getenv_system": (program(("CALL", "Vc", ("const(0x402000)",), {"callee": "getenv"}), ("CALL", "Vr", ("Vc",), {"callee": "system"})), {"command_injection"}),
    "ptr_arith_store": (program(("CALL", "V2", ("V1", "Vb", "const(0x400)"), {"callee": "recv"}), ("INT_ADD", "Vi", ("Vb", "const(0x4)")), ("STORE", None, ("const(0x1)", "Vi", "const(0x0)"))), {"write_what_where"}),
    "mult_malloc": (program(("CALL", "Vc", ("V1", "V2", "const(0x400)"), {"callee": "recv"}), ("INT_MULT", "Vs", ("Vc", "const(0x8)")), ("CALL", "Vp", ("Vs",), {"callee": "malloc"})), {"integer_overflow"}),
    "mult_malloc_checked": (
        program(("CALL", "Vc", ("V1", "V2", "const(0x400)"), {"callee": "recv"}), ("INT_LESSEQUAL", "Vk", ("Vc", "const(0x1000)")), ("CBRANCH", None, ("const(0x10)", "Vk")), ("INT_MULT", "Vs", ("Vc", "const(0x8)")), ("CALL", "Vp", ("Vs",), {"callee": "malloc"})),
        set(),
    ),
    "mask_check": (program(("CALL", None, ("Vb", "const(0x8)", "const(0x1)", "Vf"), {"callee": "fread"}), ("LOAD", "Vl", ("Vb",)), ("INT_AND", "Vt", ("Vl", "const(0xffffffff)")), ("INT_LESS", "Vo", ("Vt", "const(0x7fffffff)"))), {"integer_truncation"}),
    "full_width_check": (program(("CALL", None, ("Vb", "const(0x8)", "const(0x1)", "Vf"), {"callee": "fread"}), ("LOAD", "Vl", ("Vb",)), ("INT_LESS", "Vo", ("Vl", "const(0x7fffffff)")), ("CBRANCH", None, ("const(0x10)", "Vo"))), set()),
    "double_free": (program(("CALL", None, ("V1",), {"callee": "free"}), ("CALL", None, ("V1",), {"callee": "free"})), {"double_free"}),
    "use_after_free": (program(("CALL", None, ("V1",), {"callee": "free"}), ("LOAD", "V2", ("V1",))), {"use_after_free"}),
    "fresh_pointer_kills": (program(("CALL", None, ("V1",), {"callee": "free"}), ("CALL", "V1", ("const(0x8)",), {"callee": "malloc"}), ("LOAD", "V2", ("V1",))), set()),
    "callind_null": (program(("CALLIND", "V1", ("V0",), {"callee": "V9"}), ("INT_EQUAL", "V2", ("V1", "const(0x0)"))), {"null_dereference"}),
    "empty": ([], set()),
}


EXT = [("CALL", "Vc", ("V1", "V2", "const(0x400)"), {"callee": "recv"})]  # Vc is external data, V2 points at some
PUSH = ("CALL", None, ("V0", "V1", "Vz"), {"callee": "xmlParserInputBufferPush"})  # external, of no stated confidence
MORE = {
    "X05 address arithmetic of an external and another part": (program(PUSH, ("INT_ADD", "Va", ("Vp", "Vz")), ("STORE", None, ("Va", "Vq"))), set()),
    "X05 address arithmetic of external parts": (program(PUSH, ("INT_ADD", "Va", ("Vz", "const(0x8)")), ("STORE", None, ("Va", "Vq"))), {"write_what_where"}),
    "X05 a confidence makes any value external": (program(*EXT, ("INT_ADD", "Va", ("Vc", "const(0x8)")), ("COPY", "Vb", ("Va",)), ("STORE", None, ("Vb", "Vq"))), {"write_what_where"}),
    "X06 the read argument is the primary one": (program(*EXT, ("CALL", None, ("Vd", "V2", "const(0x8)"), {"callee": "strncat"})), set()),
    "X07 constant sizes are safe": (program(*EXT, ("CALL", None, ("Vd", "V2", "const(0x8)"), {"callee": "memcpy"})), set()),
    "X07 a size of the input": (program(*EXT, ("CALL", None, ("Vd", "V2", "Vc"), {"callee": "memcpy"})), {"buffer_overflow", "integer_overflow"}),
    "X07 format of a parameter": (program(("CALL", None, ("V0",), {"callee": "printf"})), set()),
    "X07 format of the input": (program(*EXT, ("CALL", None, ("V2",), {"callee": "printf"})), {"format_string"}),
    "X07 an allocator whose size isn't tainted": (program(("COPY", "Vs", ("const(0x8)",)), ("CALL", "Vp", ("V0", "Vs"), {"callee": "png_malloc"})), set()),
    "X07 a pointer to a function of the input": (program(*EXT, ("CALL", None, ("V0", "Vc"), {"callee": "png_safe_execute"})), {"null_dereference"}),
    "X08 unbounded writer of external input": (program(*EXT, ("CALL", None, ("V2", "Vd"), {"callee": "scanf"})), {"buffer_overflow"}),
    "X08 a bounded one": (program(*EXT, ("CALL", None, ("Vd", "Vc"), {"callee": "snprintf"})), set()),
    "X09 product of the input as a size": (program(*EXT, ("INT_MULT", "Vn", ("Vc", "const(0x8)")), ("CALL", None, ("Vd", "const(0x0)", "Vn"), {"callee": "memset"})), {"integer_overflow"}),
    "X10 results of strings are tainted, not external": (program(("CALL", "Vr", ("V0",), {"callee": "strlen"}), ("CALL", None, ("Vr",), {"callee": "printf"})), set()),
    "X13 external data in an unknown call": (program(*EXT, ("CALL", "Vr", ("V2", "Vc"), {"callee": "helper"})), {"unknown_call"}),
    "X13 one argument isn't enough": (program(*EXT, ("CALL", "Vr", ("V2",), {"callee": "helper"})), set()),
    "X13 what an unknown call returns isn't external": (program(*EXT, ("CALL", "Vr", ("Vc",), {"callee": "helper"}), ("CALL", None, ("Vr",), {"callee": "printf"})), set()),
    "X14 use after free in a call": (program(("CALL", None, ("V1",), {"callee": "free"}), ("CALL", None, ("V1", "V5"), {"callee": "strcmp"})), {"use_after_free"}),
    "X15 a field of a structure isn't a wild write": (program(*EXT, ("PTRSUB", "Vf", ("Vc", "const(0x8)")), ("STORE", None, ("Vf", "Vq"))), set()),
    "X15 X16 X19 a freed field read again": (program(("PTRSUB", "Vf", ("V0", "const(0x8)")), ("LOAD", "Vx", ("Vf",)), ("CALL", None, ("Vx",), {"callee": "free"}), ("PTRSUB", "Vg", ("V0", "const(0x8)")), ("LOAD", "Vy", ("Vg",))), {"use_after_free"}),
    "X15 a freed field set to null": (program(("PTRSUB", "Vf", ("V0", "const(0x8)")), ("LOAD", "Vx", ("Vf",)), ("CALL", None, ("Vx",), {"callee": "free"}), ("PTRSUB", "Vg", ("V0", "const(0x8)")), ("STORE", None, ("Vg", "const(0x0)")), ("LOAD", "Vy", ("Vg",))), set()),
    "X15 a store to freed memory": (program(("CALL", None, ("V1",), {"callee": "free"}), ("STORE", None, ("V1", "V2"))), {"use_after_free"}),
    "X16 data read through an external pointer": (program(*EXT, ("LOAD", "Vx", ("V2",)), ("CALL", None, ("Vx",), {"callee": "system"})), {"command_injection"}),
    "X17 a product of checked values is checked": (program(*EXT, ("INT_LESS", "Vk", ("Vc", "const(0x100)")), ("INT_MULT", "Vn", ("Vc", "const(0x4)")), ("CALL", "Vp", ("Vn",), {"callee": "malloc"})), set()),
    "X18 index by a product": (program(*EXT, ("INT_MULT", "Vn", ("Vc", "const(0x4)")), ("PTRADD", "Va", ("Vb", "Vn"))), {"integer_overflow"}),
    "X20 a narrowing mask": (program(*EXT, ("INT_AND", "Vn", ("Vc", "const(0xff)"))), {"integer_truncation"}),
    "X20 no narrowing mask": (program(*EXT, ("INT_AND", "Vn", ("Vc", "const(0xf0)"))), set()),
    "X21 too narrow to be narrowed": (program(*EXT, ("INT_AND", "Vn", ("Vc", "const(0xffffffff)"), {"sizes": [4, 4]}), ("INT_LESS", "Vk", ("Vn", "const(0x100)"))), set()),
    "X22 variables compared are no bounds check": (program(*EXT, ("INT_LESS", "Vk", ("Vc", "V9")), ("INT_MULT", "Vn", ("Vc", "const(0x4)")), ("CALL", "Vp", ("Vn",), {"callee": "malloc"})), {"integer_overflow"}),
    "X22 nor is a small constant": (program(*EXT, ("INT_EQUAL", "Vk", ("Vc", "const(0x10)")), ("INT_MULT", "Vn", ("Vc", "const(0x4)")), ("CALL", "Vp", ("Vn",), {"callee": "malloc"})), {"integer_overflow"}),
    "X25 loads before the wrong check": (program(("LOAD", "Va", ("V0",)), ("LOAD", "Vb", ("Va",)), ("INT_EQUAL", "Vk", ("Vb", "const(0x0)"))), {"null_dereference"}),
    "X25 loads after the right check": (program(("INT_EQUAL", "Vk", ("VAR_a", "const(0x0)")), ("LOAD", "VAR_a", ("V0",)), ("LOAD", "Vb", ("VAR_a",)), ("INT_EQUAL", "Vk", ("Vb", "const(0x0)"))), set()),
}


@pytest.mark.parametrize("name", [*SCENARIOS, *MORE])
def test_scenario(name):
    rows, wanted = (SCENARIOS | MORE)[name]
    found = {key[1] for key in taint.walk("f", rows, RULES).found}
    assert (found if "X13" in name else found - {"unknown_call"}) == wanted


def kinds(w):
    return {key[1] for key in w.found}


def test_unsigned_64_bit_constant():
    assert taint.const("const(0xffffffffffffffff)") == 2**64 - 1 and taint.const("V1") is None and taint.const("const(010)") == 10 and taint.const("const(x)") is None


def test_write_only_functions_without_reach_give_no_candidates_of_calls():
    rows = SCENARIOS["recv_strcpy"][0]
    quiet = taint.walk("png_write_row", rows, RULES, reach=0.0)
    assert quiet.vars and not quiet.found and taint.walk("png_read_row", rows, RULES, reach=0.0).found and taint.walk("png_write_row", rows, RULES).found


def test_taint_from_callers_is_external():
    rows = program(("COPY", "Va", ("VAR_1",)), ("CALL", None, ("Vd", "VAR_0"), {"callee": "strcpy"}))
    assert not kinds(taint.walk("f", rows, RULES)) and kinds(taint.walk("f", rows, RULES, external_args=[1])) == {"buffer_overflow"}
    assert not kinds(taint.walk("f", rows, RULES, external_args=[0, 7]))


def test_effects_of_called_functions():
    rows = program(*EXT, ("CALL", "Vr", ("Vd", "Vc"), {"callee": "fill"}), ("LOAD", "Vx", ("Vd",)))
    plain = taint.walk("f", rows, RULES)
    assert kinds(plain) == {"unknown_call"} and plain.unknown_calls == 1
    told = taint.walk("f", rows, RULES, {"fill": [(1, "return"), (1, "mem:0")]})
    assert not told.found and told.unknown_calls == 0 and told.vars["Vr"].tainted and told.vars["Vd"].memory and told.vars["Vx"].tainted
    assert not told.vars["Vr"].external and told.origin("Vr") == "interprocedural:fill:return"


def test_learned_effects():
    sink = ("CALL", "Vp", ("Vn",), {"callee": "malloc"})
    rows = program(*EXT, ("CALL", None, ("Vc", "V0"), {"callee": "is_ok"}), ("INT_MULT", "Vn", ("Vc", "const(0x4)")), sink)
    assert "integer_overflow" in kinds(taint.walk("f", rows, RULES)) and "integer_overflow" not in kinds(taint.walk("f", rows, RULES, {"is_ok": [(0, "checks")]}))
    rows = program(("CALL", None, ("Vb", "V0"), {"callee": "fetch"}), ("CALL", None, ("Vb",), {"callee": "printf"}))
    w = taint.walk("f", rows, RULES, {"fetch": [(0, "external")]})
    assert kinds(w) == {"format_string", "unknown_call"} and w.origin("Vb") == "external:llm_source:fetch" and w.unknown_calls == 1


def test_a_function_pointer_frees_fields():
    rows = program(
        ("PTRSUB", "Vt", ("const(0x0)", "const(0x401000)")), ("COPY", "Vu", ("Vt",)), ("CALL", None, ("V0", "Vu", "V2"), {"callee": "run"}),
        ("PTRSUB", "Vf", ("V2", "const(0x8)")), ("LOAD", "Vx", ("Vf",)), ("PTRSUB", "Vg", ("V0", "const(0x8)")), ("LOAD", "Vy", ("Vg",)),
    )
    effects, targets = {"drop": [(1, "field:8")]}, {0x401000: "drop"}
    w = taint.walk("f", rows, RULES, effects, targets=targets)
    assert [c["taint_var"] for c in w.found.values()] == ["Vf"] and w.unknown_calls == 0
    assert not taint.walk("f", rows, RULES, effects).found


def test_an_indirect_call_has_the_effects_of_its_target():
    rows = program(*EXT, ("PTRSUB", "Vt", ("const(0x0)", "const(0x401000)")), ("CALLIND", "Vr", ("Vc",), {"callee": "Vt"}))
    w = taint.walk("f", rows, RULES, {"id": [(0, "return")]}, targets={0x401000: "id"})
    assert w.unknown_calls == 0 and w.origin("Vr") == "interprocedural:id:return"


def test_an_allocator_is_not_told_of_its_own_sizes():
    rows = program(*EXT, ("INT_MULT", "Vn", ("Vc", "const(0x8)")), ("CALL", None, ("Vd", "const(0x0)", "Vn"), {"callee": "memset"}))
    assert kinds(taint.walk("f", rows, RULES)) == {"integer_overflow"} and not kinds(taint.walk("xmalloc", rows, RULES))


def test_branches_are_logged_only():
    w = taint.walk("f", program(*EXT, ("INT_LESS", "Vk", ("Vc", "V9")), ("CBRANCH", None, ("const(0x10)", "Vk"))), RULES)
    assert w.steps[-1]["to_var"] == "branch_condition" and not w.found


def test_paths_lead_from_the_origin():
    w = taint.walk("f", program(*EXT, ("COPY", "Va", ("Vc",)), ("COPY", "Vb", ("Va",)), ("CALL", None, ("Vb",), {"callee": "system"})), RULES)
    assert next(iter(w.found.values()))["taint_path"] == ["external:3a_seed_Vc", "Va", "Vb"]


def test_every_rule_occurs_in_the_programs(spark):
    """What the SQL is held against on the test tables isn't empty for any rule that it can express."""
    from binsift.registry import QUERIES

    d = "/root/testdata/sf0.01"
    found = {(r.vuln_type, r.sink_fn if r.sink_fn in ("STORE", "LOAD", "PTRADD") else "call", r.confidence) for r in QUERIES["x26_forward_taint"](spark, d).collect()}
    for key in [("write_what_where", "STORE", 0.6), ("use_after_free", "STORE", 0.75), ("use_after_free", "LOAD", 0.75), ("integer_overflow", "PTRADD", 0.5), ("integer_truncation", "call", 0.55), ("integer_truncation", "call", 0.75),
                ("null_dereference", "call", 0.65), ("null_dereference", "call", 0.95), ("double_free", "call", 0.8), ("use_after_free", "call", 0.75), ("unknown_call", "call", 0.35), ("buffer_overflow", "call", 0.855), ("integer_overflow", "call", 0.855)]:
        assert key in found, key
    assert {r.mark for r in QUERIES["x17_variable_marks"](spark, d).collect()} == {"memory", "mult", "checked", "narrowed", "freed"}
    reasons = {r.reason.split(":")[0] for r in QUERIES["x04_flow_steps"](spark, d).select("reason").distinct().collect()}
    assert {"param", "external", "propagate", "load", "store", "write", "return", "unknown_call"} <= reasons


CHAIN = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(CHAIN, st.sets(st.integers(0, 8), max_size=3), st.integers(0, 8))
def test_taint_is_monotone_in_its_seeds(chain, seeds, more):
    def run(seed):
        w = taint.Walk("f", RULES)
        for x in seed:
            w.taint(f"V{x}", "external:recv", None, 1.0)
        for a, b in chain:
            w.data("COPY", [f"V{a}"], [8], f"V{b}")
        return {n for n, v in w.vars.items() if v.tainted}

    assert run(seeds) <= run(seeds | {more})
    assert run(set()) == set()


OPS = "fn string, seq int, op string, callee string, out_var string, args array<string>, sizes array<int>"


def test_grouped_walk_equals_the_closure_on_programs_of_moves(spark):
    rows = [("f", i, "COPY", None, f"VAR_{i + 1}", [f"VAR_{i // 2}"], [8]) for i in range(8)] + [("g", 0, "COPY", None, "VAR_1", ["VAR_9"], [8])]
    flat = spark.createDataFrame(rows, OPS)
    walked = taint.tainted(taint.analyze(flat, external=spark.createDataFrame([("f", 0)], "fn string, arg int"))).filter("external").select("fn", "var")
    flow = flat.select("fn", F.col("args")[0].alias("src"), F.col("out_var").alias("dst"))
    closed = graph.tainted(flow, spark.createDataFrame([("f", "VAR_0")], "fn string, var string"))
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, closed.collect()))


def test_nested_records_become_flat_operations(spark):
    vn = lambda n, s="unique", z=8: (n, s, z)
    ops_ = [(0, "LOAD", "a", vn("V1"), [vn("V0")]), (1, "CAST", "b", vn("V2"), [vn("V1")]), (2, "CALL", "c", None, [vn("<strcpy>@plt", "external"), vn("V1"), vn("V2")])]
    df = spark.createDataFrame([("f", "0x1", "int f()", 3, 0.0, ["strcpy"], None, None, ops_)], FUNCTION)
    got = [(r.seq, r.op, r.callee, r.args) for r in ops.flat(df).orderBy("seq").collect()]
    assert got == [(0, "LOAD", None, ["V0"]), (1, "CALL", "strcpy", ["V1", "V2"])]


def test_effects_on_memory_of_parameters():
    copies = program(("COPY", "VAR_d", ("VAR_0",)), ("LOAD", "VAR_v", ("VAR_1",)), ("PTRADD", "VAR_e", ("VAR_d", "const(0x8)")), ("STORE", None, ("const(0x1)", "VAR_e", "VAR_v")))
    assert (1, "mem:0") in taint.summary(copies, RULES, {})
    known = {"copies": [(1, "mem:0")]}
    passes = program(("CALL", None, ("VAR_a", "VAR_b"), {"callee": "copies"}))
    assert taint.summary(passes, RULES, known) == [(1, "mem:0")]
    other = program(RECV, ("COPY", "VAR_d", ("VAR_0",)))
    assert taint.summary(other, RULES, {}) == []
    wrapper = program(("CALL", None, ("VAR_a", "VAR_b"), {"callee": "strcpy"}))
    assert taint.summary(wrapper, RULES, {}) == [(1, "mem:0")]


def test_freed_fields_of_parameters():
    direct = program(("PTRSUB", "VAR_f", ("VAR_0", "const(0x228)")), ("LOAD", "VAR_x", ("VAR_f",)), ("CALL", None, ("VAR_p", "VAR_x"), {"callee": "png_free"}))
    assert (0, "field:552") in taint.summary(direct, RULES, {})
    through = program(("PTRSUB", "VAR_t", ("const(0x0)", "const(0x10b614)")), ("CALLIND", None, ("VAR_a",), {"callee": "VAR_t"}))
    assert (0, "field:8") in taint.summary(through, RULES, {"drop": [(0, "field:8")]}, {0x10B614: "drop"})


def plain_reach(rows, seeds, effects):
    """When each variable and memory is first tainted, by relaxing every operation until nothing comes earlier."""
    rank = {o["seq"]: k for k, o in enumerate(rows)}
    live, memory = {s: -1 for s in seeds}, {}

    def lower(where, name, k):
        if name and where.get(name, 10**9) > k:
            where[name] = k
            return True
        return False

    moved = True
    while moved:
        moved = False
        for o in reversed(rows):
            k, args, out = rank[o["seq"]], o["args"], o["out"]
            on = lambda a: live.get(a, 10**9) < k  # noqa: E731, B023
            at = lambda a: memory.get(a, 10**9) < k  # noqa: E731, B023
            if o["op"] in ("CALL", "CALLIND"):
                if not any(on(a) or at(a) for a in args):
                    continue
                r, name = RULES.get(o["callee"]), o["callee"]
                new = []
                if r:
                    new += [(live, out)] * r.returns + [(live, args[i]) for i in r.external if i < len(args)]
                    to = [a for a, s in zip(args, o["sizes"]) if s == 8] if r.writes_all else [args[r.writes_at]] if 0 <= r.writes_at < len(args) else []
                    if r.external or r.writes_all or 0 <= r.reads_from < len(args) and (on(args[r.reads_from]) or live.get(args[r.reads_from]) == k):
                        new += [(memory, a) for a in to]
                elif name in effects:
                    for i, e in effects[name]:
                        if i < len(args) and on(args[i]):
                            new += [(live, out)] if e == "return" else [(memory, args[int(e[4:])])] if e.startswith("mem") and int(e[4:]) < len(args) else []
                else:
                    new += [(live, out)] + [(memory, a) for a, s in zip(args, o["sizes"]) if s == 8 and (on(a) or a == out)]
                for where, name in new:
                    moved |= lower(where, name, k)
            elif o["op"] == "STORE" and len(args) > 1 and on(args[-1]):
                moved |= lower(memory, args[-2], k)
            elif o["op"] == "LOAD" and args and (on(args[1 if len(args) > 1 else 0]) or at(args[1 if len(args) > 1 else 0])):
                moved |= lower(live, out, k)
            elif o["op"] not in ("STORE", "LOAD", "CBRANCH", "RETURN", "BRANCH") and any(map(on, args)):
                moved |= lower(live, out, k)
    return set(live), set(memory)


def programs(spark, d):
    from binsift.sources.bridge import view

    flat = ops.of_programs(view(spark, d, "b_prog"))
    rows: dict = {}
    for r in flat.orderBy("fn", "seq").collect():
        rows.setdefault(r.fn, []).append({"seq": r.seq, "op": r.op, "callee": r.callee, "out": r.out_var, "args": list(r["args"]), "sizes": list(r.sizes)})
    return flat, rows


def plain_summaries(rows):
    """Effects of all functions by a loop over them, callees first, members of cycles last."""
    calls_ = {f: {o["callee"] for o in p if o["callee"] in rows} for f, p in rows.items()}
    known, left = {}, dict(calls_)
    while left:
        ready = sorted(f for f, c in left.items() if not c & set(left)) or sorted(left)
        new = {}
        for f in ready:
            params = list(dict.fromkeys(a for o in rows[f] for a in o["args"] if a.startswith("VAR_") and a not in {x["out"] for x in rows[f]}))
            alias = {p: i for i, p in enumerate(params)}
            for o in rows[f]:
                if o["op"] in ("COPY", "CAST", "INT_ZEXT", "INT_SEXT", "PTRADD", "PTRSUB") and o["out"] and o["out"] not in alias:
                    hit = [alias[a] for a in o["args"] if a in alias]
                    if hit:
                        alias[o["out"]] = hit[0]
            back = [o["args"][0] for o in rows[f] if o["op"] == "RETURN" and o["args"] and not o["args"][0].startswith("const")]
            for i, p in enumerate(params):
                live, memory = plain_reach(rows[f], {p}, known)
                out = {"return"} if back and back[-1] in live else set()
                out |= {f"mem:{alias[v]}" for v in memory if v in alias}
                new.setdefault(f, []).extend((i, e) for e in sorted(out))
        for f, e in new.items():
            if e:
                known[f] = e
        for f in ready:
            del left[f]
    return known


def test_summaries_against_a_loop(spark, small):
    flat, rows = programs(spark, small)
    got: dict = {}
    for r in taint.summaries(flat).collect():
        if not r.effect.startswith("field"):
            got.setdefault(r.fn, set()).add((r.arg, r.effect))
    wanted = {f: set(e) for f, e in plain_summaries(rows).items()}
    assert got == wanted and sum(map(len, got.values())) > 50


def test_external_arguments_against_a_loop(spark, small):
    flat, rows = programs(spark, small)
    marks: dict = {}
    for f, p in rows.items():
        seeds = set()
        for o in p:
            r = RULES.get(o["callee"])
            if r and (r.external or r.writes_all):
                seeds |= {o["args"][i] for i in r.external if i < len(o["args"])} | ({a for a, s in zip(o["args"], o["sizes"]) if s == 8} if r.writes_all else {o["args"][r.writes_at]} if 0 <= r.writes_at < len(o["args"]) else set())
                seeds |= {o["out"]} if r.returns and o["out"] else set()
        if seeds:
            marks.setdefault(f, set()).add(-1)
            live, _ = plain_reach(p, seeds, {})
            for o in p:
                if o["op"] in ("CALL", "CALLIND"):
                    for i, a in enumerate(o["args"]):
                        if a in live and o["callee"]:
                            marks.setdefault(o["callee"], set()).add(i)
    while True:
        before = {f: set(m) for f, m in marks.items()}
        for f, p in rows.items():
            for o in p:
                if o["op"] in ("CALL", "CALLIND") and o["callee"] in marks:
                    marks.setdefault(f, set()).update(i for i, a in enumerate(o["args"]) if a.startswith("VAR_"))
        if marks == before:
            break
    got: dict = {}
    for r in taint.external_arguments(flat).collect():
        if r.fn:
            got.setdefault(r.fn, set()).add(r.arg)
    assert {f: m for f, m in got.items() if m} == {f: m for f, m in marks.items() if m}


def test_functions_of_two_programs_stay_apart(spark):
    rows = [("a", "f", 0, "CALL", "g", None, ["V0"], [8]), ("a", "g", 0, "CALL", "free", None, ["V0"], [8]), ("b", "f", 0, "CALL", "g", None, ["V1"], [8])]
    flat = spark.createDataFrame(rows, "binary string, " + OPS)
    got = ops.qualified(flat, F.col("binary")).select("fn", "callee").collect()
    assert sorted(map(tuple, got)) == [("a!f", "a!g"), ("a!g", "free"), ("b!f", "g")]


def test_functions_above_the_size_filter_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(taint, "MOST_OPS", 3)
    rows = [("big", i, "COPY", None, f"V{i + 1}", [f"V{i}"], [8]) for i in range(4)] + [("small", 0, "COPY", None, "V1", ["V0"], [8])]
    assert [r.fn for r in taint.analyze(spark.createDataFrame(rows, OPS)).collect()] == ["small"]


def test_backward_slices():
    rows = program(("CALL", "Va", ("V0",), {"callee": "getenv"}), ("COPY", "Vb", ("Va",)), ("INT_ADD", "Vc", ("Vb", "V9")), ("CALL", "Vd", ("Vc",), {"callee": "helper"}), ("COPY", "Ve", ("const(0x1)",)))
    assert taint.backward(rows, "Vb") == (0.65, 2) and taint.backward(rows, "Vd") == (0.65, 4) and taint.backward(rows, "Ve") == (0.0, 1)
    assert taint.backward(rows, "V9") == (0.55, 0) and taint.backward(rows, "Vd", 1) == (0.0, 1)
    chain_ = program(*[("COPY", f"V{k + 1}", (f"V{k}",)) for k in range(30)])
    assert taint.backward(chain_, "V30") == (0.0, 20)  # beyond the depth nothing is known


def test_evidence_of_candidates():
    w = taint.walk("f", program(*EXT, ("INT_MULT", "Vn", ("Vc", "const(0x8)")), ("CALL", "Vp", ("Vn",), {"callee": "malloc"})), RULES)
    c = next(iter(w.found.values()))
    assert (c["hops"], c["var_conf"], c["seed_fn"], c["mult"], c["checked"], c["backward_conf"]) == (1, 1.0, None, True, False, None)
    w = taint.walk("f", program(("CALL", None, ("VAR_0", "VAR_1"), {"callee": "png_safe_execute"})), RULES)
    c = next(iter(w.found.values()))
    assert c["var_conf"] == 0 and c["backward_conf"] == 0.55 and c["backward_depth"] == 0
