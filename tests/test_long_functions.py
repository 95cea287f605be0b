"""Functions beyond the size filter are whole functions to the queries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_functionwise import OPS, RECURSIVE, RULES, effects_of

from binsift.operators import ops, taint
from binsift.registry import QUERIES
from binsift.sources.bridge import view

LONG = taint.MOST_OPS + 100


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    """events of one function of LONG operations and a few short ones."""
    sf = tmp_path_factory.mktemp("long")
    k = (F.col("id") * 31 + F.floor(F.col("id") / 7)) % 100
    user = F.when(F.col("id") < LONG, 3000).otherwise(3001 + F.col("id") % 3).cast("long")
    spark.range(LONG + 120).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), user.alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.format_string('{"k": %d}', k).alias("props")
    ).write.parquet(f"{sf}/events.parquet")
    return str(sf)


def dicts(flat, fn):
    rows = flat.filter(F.col("fn") == fn).select("seq", "op", "callee", F.col("out_var").alias("out"), "args", "sizes").orderBy("seq").collect()
    return [r.asDict() for r in rows]


@pytest.fixture(scope="module")
def candidates(spark, long_table):
    """What one walk over all operations of the long function finds; it is called by none and calls none of the program."""
    flat = ops.of_programs(view(spark, long_table, "b_prog"))
    rows = dicts(flat, "fn_3000")
    assert len(rows) == LONG
    marked = [r.arg for r in taint.external_arguments(flat, whole=True).filter("fn = 'fn_3000' AND arg >= 0").collect()]
    return list(taint.walk("fn_3000", rows, RULES, None, marked).found.values())


def test_x11_walks_a_long_function(spark, long_table, candidates):
    got = QUERIES["x11_taint_through_calls"](spark, long_table).filter("fn = 'fn_3000'").collect()
    assert candidates and sorted(repr(r.asDict()) for r in got) == sorted(repr({"fn": "fn_3000"} | {c: x[c] for c in taint.CANDIDATE[1:]}) for x in candidates)


def random_program(rng, n):
    names = [f"VAR_{k}" for k in range(9)]
    callees = ["recv", "memcpy", "malloc", "free", "strcpy", "known", "marked", "nobody", "scanf"]
    rows = []
    for seq in range(n):
        op = rng.choice(["CALL", "CALL", "COPY", "CAST", "LOAD", "STORE", "INT_ADD", "INT_LESS", "CBRANCH", "RETURN", "PTRSUB", "CALLIND"])
        args = [rng.choice([*names, "const(0x8)"]) for _ in range(rng.randint(1, 3))]
        out = rng.choice(names[3:]) if op not in ("STORE", "CBRANCH", "RETURN") and rng.random() < 0.8 else None
        rows.append({"seq": seq, "op": op, "callee": rng.choice(callees) if op == "CALL" else None, "out": out, "args": args, "sizes": [rng.choice([4, 8]) for _ in args]})
    return rows


KNOWN = {"known": [(0, "return"), (0, "mem:1"), (1, "mem:2"), (5, "return")], "marked": [(0, taint.INSIDE)]}


def test_parameters_followed_together_are_those_followed_alone(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        rows = random_program(rng, 25)
        together = taint.summary(rows, RULES, KNOWN)
        with monkeypatch.context() as m:
            m.setattr(taint, "BLOCK", 1)
            assert taint.summary(rows, RULES, KNOWN) == together
        for widest in (0, 1, 2, 20):
            met = [(i, e) for i, e in together if i < widest and not (e.startswith("mem:") and int(e[4:]) >= widest)]
            assert taint.summary(rows, RULES, KNOWN, widest=widest) == sorted([*met, *([(0, taint.INSIDE)] if len(met) < len(together) else [])])


def test_effects_that_no_call_meets_change_no_walk(spark):
    """beyond has an effect on its third parameter only, and calls pass two."""
    extra = [("beyond", 0, "COPY", None, "VAR_c", ["VAR_a"], [8]), ("beyond", 1, "COPY", None, "VAR_d", ["VAR_b"], [8]), ("beyond", 2, "RETURN", None, None, ["VAR_z"], [8])]
    calls = [("caller", 0, "CALL", "recv", "VAR_0", ["VAR_s", "VAR_b"], [8, 8]), ("caller", 1, "CALL", "beyond", "VAR_1", ["VAR_b", "VAR_s"], [8, 8]), ("caller", 2, "CALL", "top", "VAR_2", ["VAR_b"], [8]), ("caller", 3, "CALL", "system", None, ["VAR_2"], [8])]
    flat = spark.createDataFrame([*RECURSIVE, *extra, *calls], OPS)
    full, met = taint.summaries(flat), taint.summaries(flat, whole=True, met=True)
    assert ("beyond", 2, "return") in effects_of(full) and ("beyond", 0, taint.INSIDE) in effects_of(met) and ("beyond", 2, "return") not in effects_of(met)
    walked = [sorted(repr(r) for r in taint.analyze(flat, e, taint.external_arguments(flat, e)).collect()) for e in (full, met)]
    assert walked[0] == walked[1] and "interprocedural:top:return" in repr(walked[0]) and "unknown_call:" not in repr(walked[0])


def test_e06_has_evidence_of_a_long_function(spark, long_table, candidates):
    got = QUERIES["e06_evidence_vectors"](spark, long_table).filter("fn = 'fn_3000'").select("seq", "vuln_type", "sink_fn", "taint_source", "taint_path").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((x["seq"], x["vuln_type"], x["sink_fn"], x["taint_source"], x["taint_path"])) for x in candidates)


def test_e09_has_findings_of_a_long_function(spark, long_table, candidates):
    got = QUERIES["e09_findings_without_models"](spark, long_table).filter("fn = 'fn_3000' AND match_kind IS NOT NULL").select("vuln_type", "sink_fn", "confirmed").collect()
    assert {(r.vuln_type, r.sink_fn) for r in got} == {(x["vuln_type"], x["sink_fn"]) for x in candidates} and any(r.confirmed for r in got)


def test_s17_shows_findings_of_a_long_function(spark, long_table, candidates):
    page = QUERIES["s17_html_report"](spark, long_table).first().html
    rows = [x for x in page.split("\n") if x.startswith("<tr class=")]
    sure = {(x["vuln_type"], x["sink_fn"]) for x in candidates if x["match_kind"] == "LIBRARY_MATCH" and "alloc" not in x["sink_fn"]}
    assert sure and all(any(f"<td>{kind}</td><td>fn_3000</td><td>{sink}</td>" in x for x in rows) for kind, sink in sure)
