from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binsift.functions import dims
from binsift.operators import fuse, report, select, store
from binsift.operators.select import adaptive_quotas
from binsift.sources import records
from binsift.streaming import ingest

LINE = {"name": "f", "entry_addr": "00101", "prototype": "int f(int size)", "call_sites": ["recv"], "ops": [{"seq": 0, "op": "LOAD", "addr": "a", "output": {"name": "V1", "size": 8}, "inputs": [{"name": "V0", "space": "unique", "size": 8}]}], "extra": 1}


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return f"file://{path}"


def test_tolerant_reader_skips_broken_lines_and_fills_defaults(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [LINE, "", "{broken", {"name": "g"}, LINE | {"prototype": "last"}])
    got = {r.name: r for r in records.read_functions(spark, path).collect()}
    assert set(got) == {"f", "g"} and got["f"].prototype == "last"
    assert got["g"].ops == [] and got["g"].entry_addr == "0x0" and got["f"].ops[0].output.space is None


def test_ranked_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0.123456, False, 0.98765), ("g", 0.5, True, 0.1)], "name string, score double, discarded boolean, role_confidence double")
    records.write_ranked(rows, str(tmp_path / "r"))
    got = records.read_ranked(spark, str(tmp_path / "r")).select("name", "score", "role_confidence", "reachability_score").collect()
    assert [tuple(r) for r in got] == [("f", 0.1235, 0.988, 1.0)]


def test_resume_keeps_what_is_there(spark, tmp_path):
    make = lambda n: lambda: spark.range(n)
    path = str(tmp_path / "t")
    assert records.resumed(spark, path, make(3)).count() == 3
    assert records.resumed(spark, path, make(5)).count() == 3
    assert records.resumed(spark, path, make(5), force=True).count() == 5
    assert records.read_json_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_labels_and_datasets(spark, tmp_path):
    (tmp_path / "l.csv").write_text("bug_id,function_name,label\nB1,f,1\nB2,g,0\n")
    assert records.read_labels(spark, str(tmp_path / "l.csv")).count() == 1
    assert records.read_labels(spark, str(tmp_path / "l.csv"), positive_only=False).count() == 2
    for lib, variant in (("png", "vuln_O0"), ("png", "vuln_O2"), ("tif", "vuln_O2")):
        d = tmp_path / "data" / lib / variant
        d.mkdir(parents=True)
        write(d / "p.jsonl", [LINE | {"name": variant}])
    got = records.read_datasets(spark, f"{tmp_path}/data").select("library", "name").collect()
    assert sorted(map(tuple, got)) == [("png", "vuln_O0"), ("tif", "vuln_O2")]


def test_store_seeds_once_and_replaces_whole(spark, tmp_path):
    s, schema = store.Store(spark, str(tmp_path / "s")), "fn string, v int"
    one = spark.createDataFrame([("a", 1)], schema)
    assert s.read("t", schema).count() == 0
    assert s.seed("t", one, schema).count() == 1
    s.seed("t", one.union(one), schema)
    new = store.latest(s.read("t", schema), spark.createDataFrame([("a", 2), ("b", 1)], schema), ["fn"], "v")
    s.write("t", new)
    assert sorted(map(tuple, s.read("t", schema).collect())) == [("a", 2), ("b", 1)]


def test_reports(spark):
    rows = spark.createDataFrame([("f", "buffer_overflow", "memcpy", "high", 90), ("g<x>", "format_string", "printf", "critical", 80)], "fn string, vuln_type string, sink_fn string, severity string, conf_pct int")
    doc = json.loads(report.json_report(rows, spark.createDataFrame([], "fn string, vuln_type string, reason string"), "bin", "fn").first().report)
    assert [f["id"] for f in doc["confirmed_vulnerabilities"]] == ["VULN-001", "VULN-002"] and doc["confirmed_vulnerabilities"][0]["severity"] == "critical"
    none = spark.createDataFrame([("h", "use_after_free", "no path")], "fn string, vuln_type string, reason string")
    page = report.html_report(rows, none, "a<b", "fn").first().html
    assert "a&lt;b" in page and "no path" in page and page.endswith("</html>")
    assert "g&lt;x&gt;" in page and page.index("VULN-001") < page.index("VULN-002")


def test_results_and_costs_are_written(spark, tmp_path):
    from binsift.operators import metrics

    metrics.write_results(spark.createDataFrame([("a", 1)], "k string, v int"), f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r/csv").first().k == "a" and spark.read.json(f"file://{tmp_path}/r/json").first().v == 1
    metrics.write_costs(spark.createDataFrame([("a", 10), ("b", 5)], "stage string, tokens long"), 2.0, f"file://{tmp_path}/c")
    total = spark.read.json(f"file://{tmp_path}/c/summary").filter("stage = 'TOTAL'").first()
    assert total.tokens == 15 and spark.read.json(f"file://{tmp_path}/c/records").count() == 2


def test_order_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = report.in_order(rows, F.desc("k"), F.col("id")).orderBy("order").collect()
    assert [r.order for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_order_takes_one_shuffle_of_the_rows(spark):
    rows = report.in_order(spark.range(1000), F.desc("id"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1  # over the counts of ranges


def test_quota_drops_rows_before_the_shuffle(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "id % 97 AS score", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE 'c' END AS category")
    got = select.by_quota(rows, {"a": 5, "b": 2}, 20, "score", "id")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    every = sorted(((r.category, r.score, r.id) for r in rows.collect()), key=lambda x: (-x[1], x[2]))
    own = [x for c, n in (("a", 5), ("b", 2)) for x in [y for y in every if y[0] == c][:n]]
    rest = [x for x in every if x not in own][: 20 - len(own)]
    assert sorted((r.category, r.score, r.id, r.filled) for r in got.collect()) == sorted([(*x, False) for x in own] + [(*x, True) for x in rest])


def test_rows_that_tie_are_the_same_in_any_order(spark):
    rows = [("f", "v", 7, c) for c in (90, 82, 94, 86, 84, 96)]
    schema = "fn string, vuln_type string, cand_id int, conf_pct int"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, schema).repartition(3)
        assert select.keep_first(df, ["fn", "vuln_type"], "cand_id", "conf_pct").first().conf_pct == 82
        lines = report.numbered(df.withColumn("severity", F.lit("high")), "cand_id", "fn", "vuln_type", "conf_pct").orderBy("order").collect()
        assert [r.conf_pct for r in lines] == [82, 84, 86, 90, 94, 96]


def test_dedup_is_idempotent_and_order_free(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 4, 1)], "fn string, cand_id int, conf int")
    once = select.keep_max(rows, ["fn"], "conf", "cand_id")
    again = select.keep_max(once, ["fn"], "conf", "cand_id")
    shuffled = select.keep_max(rows.orderBy(F.desc("cand_id")), ["fn"], "conf", "cand_id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == sorted(map(tuple, shuffled.collect())) == [("a", 2, 9), ("b", 4, 1)]


def test_ablation_computes_signals_once(spark):
    rows = spark.createDataFrame([(1, "external:fread"), (2, "zzz")], "cand_id long, src string")
    found = fuse.signals(F.lit(0.8), F.lit("LIBRARY_MATCH"), F.lit(8), F.lit(0.4), F.col("src"), F.lit(False))
    got = fuse.ablation(rows, found, "cand_id")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(src") <= len(dims.SOURCE_TRUST)
    want = {(r.cand_id, k or "none"): r.c for k in (None, *dims.CALIBRATION) for r in rows.select("cand_id", F.round(fuse.calibrated(found, neutral=k), 6).alias("c")).collect()}
    assert {(r.cand_id, r.signal): r.confidence for r in got.collect()} == want


def test_posterior_grows_with_its_prior(spark):
    rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("p"))
    got = [r.x for r in rows.select("p", fuse.posterior(F.col("p"), F.lit(0.7)).alias("x")).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 1


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.sampled_from(["parser", "validator", "memory"]), st.floats(0, 1)), st.integers(20, 300))
def test_quotas_fill_the_budget(shares, budget):
    quotas = adaptive_quotas(shares, budget)
    assert min(quotas.values()) >= 1 and sum(quotas.values()) <= budget + len(quotas)


def test_stream_keeps_the_first_of_each_fingerprint(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.jsonl", [LINE | {"fingerprint": "x"}, LINE | {"name": "g", "fingerprint": "x"}, LINE | {"name": "h", "fingerprint": "y"}])
    stream = ingest.first_of_each(ingest.functions(spark, str(folder)))
    ingest.each_batch(stream, lambda b: b.select("name", "fingerprint"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and {r.fingerprint for r in got.collect()} == {"x", "y"}


def test_answers_of_services_take_their_schema(spark):
    from binsift.sources import external

    q = spark.createDataFrame([("f", "talk {\"a\": 1} end"), ("g", "none")], "fn string, text string")
    assert external.ask("summaries", q).count() == 0
    got = external.ask("verdicts", q, lambda d: d.select("fn", F.lit("7").alias("cand_id")))
    assert got.columns == ["cand_id", "confirmed", "confidence", "reasoning"] and got.first().cand_id == 7
    assert [r.x for r in q.select(external.parsed(F.col("text"), "a int")["a"].alias("x")).collect()] == [1, None]
