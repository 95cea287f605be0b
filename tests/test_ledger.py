from __future__ import annotations

import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from binsift.operators import ledger as ledgers
from binsift.operators import services
from binsift.operators.ledger import Ledger

ANSWER = "fn string, analysis_type string, vuln_type string, confidence double, reasoning string"


def counting(folder, fails=lambda fn, analysis: False):
    """A service that leaves a file for each question it gets, and whose answers differ each time."""

    def service(questions):
        def run(frames):
            for q in frames:
                for fn, analysis in zip(q["fn"], q["analysis_type"]):
                    if fails(fn, analysis):
                        raise ConnectionError(fn)
                    Path(folder, uuid.uuid4().hex).write_text(f"{fn} {analysis}")
                out = q[["fn", "analysis_type"]].assign(vuln_type=[uuid.uuid4().hex for _ in range(len(q))], confidence=0.9, reasoning="")
                yield out

        return questions.mapInPandas(run, ANSWER)

    return service


def asked(folder):
    return sorted(p.read_text() for p in Path(folder).iterdir())


@pytest.fixture
def functions(spark):
    return spark.createDataFrame([(f"f{i}",) for i in range(10)], "fn string")


def test_chained_analyses_ask_each_question_once(functions, tmp_path):
    got = services.chained(functions, counting(tmp_path))
    assert len(asked(tmp_path)) == 50 == len(set(asked(tmp_path)))
    first, again = sorted(map(tuple, got.collect())), sorted(map(tuple, got.collect()))
    assert first == again and len(first) == 50 and len(asked(tmp_path)) == 50


def test_a_failed_analysis_goes_on_where_it_ended(spark, functions, tmp_path):
    seen, broken = tmp_path / "seen", tmp_path / "broken"
    seen.mkdir()
    broken.write_text("")

    def fails(fn, analysis):
        if analysis != "lifetime" or fn != "f7" or not broken.exists():
            return False
        time.sleep(3)  # the others are done by then
        return True

    once, ledger = counting(seen, fails), Ledger(spark, f"file://{tmp_path}/ledger", per_task=1)
    with pytest.raises(Exception, match="f7"):
        services.chained(functions, once, ledger=ledger)
    assert len(asked(seen)) == 29
    broken.unlink()
    got = services.chained(functions, once, ledger=ledger)
    assert got.count() == 50 and sorted(set(asked(seen))) == asked(seen) and len(asked(seen)) == 50
    services.chained(functions, once, ledger=Ledger(spark, f"file://{tmp_path}/ledger")).count()
    assert len(asked(seen)) == 50


def test_a_task_that_failed_loses_no_finished_answers(spark, tmp_path):
    """Every question in a task of its own; one fails after the others are done."""
    seen = tmp_path / "seen"
    seen.mkdir()
    fails = tmp_path / "fails"
    fails.write_text("")

    def slow(fn, analysis):
        if fn == "f3" and fails.exists():
            time.sleep(3)
            return True
        return False

    ledger = Ledger(spark, f"file://{tmp_path}/ledger", per_task=1)
    questions = spark.createDataFrame([(f"f{i}", "a") for i in range(4)], "fn string, analysis_type string")
    service = counting(seen, slow)
    with pytest.raises(Exception, match="f3"):
        ledger.ask("semantic_assessments", questions, service, ["fn"])
    before = asked(seen)
    fails.unlink()
    got = ledger.ask("semantic_assessments", questions, service, ["fn"])
    assert {r.fn for r in got.collect()} == {"f0", "f1", "f2", "f3"}
    assert before == ["f0 a", "f1 a", "f2 a"] and asked(seen) == [*before, "f3 a"]


def test_attempts(spark, functions, tmp_path):
    seen, broken = tmp_path / "seen", tmp_path / "broken"
    seen.mkdir()

    def fails(fn, analysis):
        if fn != "f5" or broken.exists():
            return False
        broken.write_text("")
        return True

    questions = functions.withColumn("analysis_type", F.lit("a"))
    got = Ledger(spark).ask("semantic_assessments", questions, counting(seen, fails), ["fn"], attempts=2)
    assert got.count() == 10 and sorted(set(asked(seen))) == sorted(f"f{i} a" for i in range(10))


def test_questions_without_an_answer_are_not_asked_again(spark, tmp_path):
    seen = []

    def service(q):
        seen.append(sorted(r.target for r in q.collect()))
        return q.filter("target = 'a'").select("target", F.lit("x").alias("name"))

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ask = lambda *names: sorted((r.target, r.name) for r in services.callee_names(spark.createDataFrame([(n,) for n in names], "target string"), service, ledger).collect())
    assert ask("a", "b", "b") == [("a", "x"), ("b", None)] == ask("b", "a")
    assert ask("c", "a") == [("a", "x"), ("c", None)]
    assert seen == [["a", "b"], ["c"]]
    assert ask() == [] and services.callee_names(spark.createDataFrame([("a",)], "target string"), None).first().name is None


def test_another_question_of_the_same_thing_is_asked(spark, tmp_path):
    ledger, seen = Ledger(spark), []

    def service(q):
        seen.append(q.count())
        return q.select("cand_id", F.lit(True).alias("confirmed"), F.col("conf_pct").cast("double").alias("confidence"))

    one = spark.createDataFrame([(1, 90)], "cand_id long, conf_pct int")
    other = spark.createDataFrame([(1, 80)], "cand_id long, conf_pct int")
    for q, c in ((one, 90.0), (other, 80.0), (one, 90.0)):
        assert [(r.cand_id, r.confidence) for r in ledger.ask("reviews", q, service, ["cand_id"]).collect()] == [(1, c)]
    assert seen == [1, 1]
    ledger.ask("reviews", one, service, ["cand_id"], name="second")
    assert seen == [1, 1, 1]


def test_questions_that_agree_in_their_key_share_answers(spark):
    rows = spark.createDataFrame([(1, "disagrees", 0.5), (1, "disagrees", 0.6), (2, "agrees_safe", 0.5)], "cand_id long, kind string, confidence double")
    service = lambda q: q.select("cand_id", F.lit(True).alias("confirmed"), F.lit(0.9).alias("confidence")).distinct()
    got = services.arbitrated(rows, service)
    assert sorted((r.cand_id, r.confirmed, r.confidence) for r in got.collect()) == [(1, True, 0.9), (1, True, 0.9), (2, False, 0.2)]


def test_tasks_do_not_grow_with_the_questions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgers, "MOST_TASKS", 8)
    parts = []

    def service(q):
        parts.append(q.rdd.getNumPartitions())
        return q.select("target", F.concat("target", F.lit("!")).alias("name"))

    root = f"file://{tmp_path}/ledger"
    for n in (20, 3000):
        got = Ledger(spark, root, per_task=4).ask("callee_names", spark.range(n).select(F.col("id").cast("string").alias("target")), service, ["target"])
        assert sorted((r.target, r.name) for r in got.collect()) == sorted((str(i), f"{i}!") for i in range(n))
    assert parts == [5, 8]
