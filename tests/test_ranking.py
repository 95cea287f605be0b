"""The ranking of functions as a whole against loops over functions and edges."""

from __future__ import annotations

import pytest

from binsift.functions import dims
from binsift.operators import ops, pipeline
from binsift.registry import QUERIES
from binsift.sources.bridge import view

WORDS = [s.lower() for s in dims.TAINT_SOURCES]
DANGEROUS = WORDS + [s.lower() for s in dims.TAINT_SINKS]


def has(text, words):
    return text is not None and any(w in text.lower() for w in words)


def closure(start, against, hops):
    """Least number of edges from the start to each node, going by `against` (node -> next ones)."""
    dist, front, d = dict.fromkeys(start, 0), set(start), 0
    while front and (hops is None or d < hops):
        d += 1
        front = {m for n in front for m in against.get(n, ())} - set(dist)
        dist |= dict.fromkeys(front, d)
    return dist


def call_points(callee):
    r = next((r for r in dims.rule_rows() if r[0] == callee), None)
    if r is None:
        return 0.0
    name, external, writes_at, writes_all, _, returns, bounded, _, _, _, sink, kind, _, confidence, score = r
    points = score
    if sink:
        points += 10 + {"command_injection": 5, "buffer_overflow": 4, "format_string": 3, "uaf": 2}.get(kind, 0)
        points += 5 if not bounded and (writes_at >= 0 or writes_all) else 0
    points += 3 if external or writes_all else 0
    points += 2 if returns else 0
    return round(points * confidence + 1e-9, 2)


def role_of(fn, c):
    for role, ps in dims.ROLE_PATTERNS.items():
        for p in ps.split():
            if p in fn.lower():
                return role, 0.90 if len(p) >= 6 else 0.75
    n = lambda *k: sum(c.get(x, 0) for x in k)
    calls, shifts, adds = n("CALL", "CALLIND"), n("INT_LEFT", "INT_RIGHT", "INT_SRIGHT"), n("INT_ADD", "INT_SUB")
    compares, total = n("INT_LESS", "INT_LESSEQUAL", "INT_SLESS", "INT_SLESSEQUAL"), c["all"]
    if n("LOAD") <= 2 and n("STORE") <= 2 and calls <= 3 and n("INT_MULT") == 0 and n("CBRANCH") <= 3:
        return "error_handler", 0.40
    if n("CBRANCH") >= 3 and compares >= 2 and n("STORE") * 20 < total:
        return "validator", 0.55
    if n("CBRANCH") >= 4 and n("LOAD") >= 5 and calls >= 2:
        return "parser", 0.50
    if n("INT_MULT") + adds + shifts >= 10 and n("LOAD") <= 3 and calls <= 2:
        return "math", 0.45
    if c["alloc"] and calls <= 4:
        return "allocator", 0.60
    return "unknown", 0.0


def plain_ranking(programs, edges):
    """Scores, total, role, category and final score of each function."""
    nodes = sorted({x for e in edges for x in e})
    down, up = {}, {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
        up.setdefault(b, set()).add(a)
    sources = [n for n in nodes if has(n, WORDS)]
    near = closure(sources, up, 4)
    above = closure(sources, up, None)
    reachable = set(above) if len(above) >= 0.05 * len(nodes) else {n for n in nodes if not has(n, ["write", "encode", "emit"])}
    direct = {a for a, b in edges if has(b, DANGEROUS)}
    reaches = set(closure(direct, up, 2))
    rank, base = dict.fromkeys(nodes, 1 / len(nodes)), {n: 0.15 / len(sources) if n in sources else 0.0 for n in nodes}
    for _ in range(25):
        rank = {n: base[n] + 0.85 * sum(rank[m] / len(up[m]) for m in down.get(n, ())) for n in nodes}
    top = max(rank.values())
    ppr = {n: round(r / top, 4) for n, r in rank.items()}
    out = {}
    for fn, rows in programs.items():
        c = {"all": len(rows), "alloc": any(has(o["callee"], ["alloc"]) for o in rows)}
        for o in rows:
            c[o["op"]] = c.get(o["op"], 0) + 1
        n = lambda *k: sum(c.get(x, 0) for x in k)  # noqa: B023, E731
        first, unchecked = {}, False
        for o in rows:
            if o["op"] in ("INT_ADD", "INT_SUB", "INT_MULT") and o["out"]:
                first.setdefault(o["out"], o["seq"])
        for v, made in first.items():
            checks = [o["seq"] for o in rows if o["op"] == "CBRANCH" and v in o["args"]]
            unchecked |= any(o["op"] == "STORE" and v in o["args"] and o["seq"] > made and not (checks and min(checks) <= o["seq"]) for o in rows)
        role, conf = role_of(fn, c)
        inputs, sinks = {o["callee"] for o in rows if has(o["callee"], WORDS)}, {o["callee"] for o in rows if has(o["callee"], [s.lower() for s in dims.TAINT_SINKS])}
        points = sum(call_points(o["callee"]) for o in rows if o["op"] == "CALL" and o["callee"])
        reach, dist = fn in reachable, near.get(fn, 5)
        cap = lambda x: round(min(1.0, x), 6)
        e = 0.35 * reach + {0: 0.5, 1: 0.5, 2: 0.35, 3: 0.2, 4: 0.1}.get(dist, 0) + 0.2 * bool(inputs) + conf * {"parser": 0.2, "decoder": 0.2, "dispatcher": 0.1}.get(role, 0)
        a = min(0.25 * n("INT_MULT"), 0.5) + min(0.1 * n("INT_LEFT", "INT_RIGHT", "INT_SRIGHT"), 0.2) + min(0.1 * n("PTRADD", "PTRSUB"), 0.2) + min(0.08 * n("INT_ZEXT", "INT_SEXT"), 0.15) + min(0.02 * n("INT_ADD", "INT_SUB"), 0.15) + 0.35 * unchecked
        v = min(10 * n("CBRANCH") / c["all"], 0.35) + min(0.08 * n("INT_LESS", "INT_LESSEQUAL", "INT_SLESS", "INT_SLESSEQUAL"), 0.25) + (conf * 0.35 if role == "validator" else 0) + 0.15 * (role == "parser" and n("INT_MULT") > 0) + 0.2 * unchecked
        g = (0.6 * ppr.get(fn, 0.0) + 0.2 * reach + 0.2 * (fn in reaches)) * (0.5 if len(down.get(fn, ())) > 30 else 1.0)
        w = 0.5 if role in ("parser", "validator", "decoder") else 0.35 if role in ("state_machine", "dispatcher") else 0.0 if role in ("unknown", "error_handler", "checksum", "math") else 0.2
        m = min(3 * n("LOAD") / c["all"], 0.4) + min(3 * n("STORE") / c["all"], 0.4) + 0.15 * c["alloc"]
        d = (0.7 if sinks else 0.5 if inputs else 0.0) + 0.2 * bool(sinks) + 0.3 * bool(sinks or inputs)
        s = dict(exposure=cap(e), validation=cap(v), arithmetic=cap(a), graph=cap(g), semantic=cap(w * conf * conf), pattern_store=cap(points / 20), memory=cap(m), dangerous_calls=cap(d))
        total = round(sum(s[k] * x for k, x in dict(exposure=0.2, validation=0.2, arithmetic=0.2, graph=0.15, semantic=0.1, pattern_store=0.05, memory=0.05, dangerous_calls=0.05).items()) + 1e-10, 4)
        category = "arithmetic" if s["arithmetic"] >= 0.6 and s["arithmetic"] >= s["exposure"] else dims.ROLE_CATEGORY.get(role, "unknown")
        out[fn] = s | {"total": total, "role": role, "category": category, "ops": c["all"]}
    final = {fn: r["total"] for fn, r in out.items()}
    for _ in range(2):
        final = {
            fn: round(t + min(0.15 * sum(final.get(b, 0.0) for b in down.get(fn, ())), 2.0 if out[fn]["ops"] > 500 else 999.0) + 0.1 * sum(final.get(b, 0.0) for b in up.get(fn, ())) + 1e-10, 4)
            for fn, t in final.items()
        }
    return {fn: r | {"final": final[fn]} for fn, r in out.items()}


@pytest.fixture(scope="module")
def wanted(spark, small):
    programs: dict = {}
    for r in ops.of_bridge(view(spark, small, "b_ops")).orderBy("fn", "seq").collect():
        programs.setdefault(r.fn, []).append({"seq": r.seq, "op": r.op, "callee": r.callee, "out": r.out_var, "args": list(r["args"])})
    return plain_ranking(programs, {(r.caller, r.callee) for r in view(spark, small, "b_edges").collect()})


def test_ranked_functions(spark, small, wanted):
    rows = QUERIES["r11_ranked_functions"](spark, small).collect()
    assert {r.fn for r in rows} == set(wanted) and len(rows) == len(wanted)
    for r in rows:
        for k, v in r.asDict().items():
            if k != "fn":
                assert v == (pytest.approx(wanted[r.fn][k], abs=2e-4) if isinstance(v, float) else wanted[r.fn][k]), (r.fn, k)


def test_selected_functions(spark, small, wanted):
    """Categories up to their quotas by score, then the rest, of the operator's own scores."""
    ranked = {r.fn: r for r in pipeline.ranked(ops.of_bridge(view(spark, small, "b_ops")), view(spark, small, "b_edges"), dims.rules(spark)).collect()}
    assert {fn: r.category for fn, r in ranked.items()} == {fn: r["category"] for fn, r in wanted.items()}
    raw = {c: b * max(0.5, min(2.0, {"parser": 0.3, "memory": 0.2}.get(c, 0.0) / max(b, 0.01))) for c, b in dims.QUOTA_SHARE.items()}
    quota = {c: max(1, int(x / sum(raw.values()) * 30)) for c, x in raw.items()}
    for c in sorted(quota, key=lambda c: -quota[c])[: max(0, 30 - sum(quota.values()))]:
        quota[c] += 1
    order = sorted(ranked.values(), key=lambda r: (-r.final, r.fn))
    taken = {c: 0 for c in quota}
    first = [r for r in order if (taken.__setitem__(r.category, taken[r.category] + 1) or taken[r.category] <= quota[r.category])]
    rest = [r for r in order if r not in first]
    want = [(r.fn, r.category, False) for r in first] + [(r.fn, r.category, True) for r in rest]
    got = QUERIES["r11b_selected_functions"](spark, small).select("fn", "category", "filled").collect()
    assert sorted(map(tuple, got)) == sorted(want[:40])
