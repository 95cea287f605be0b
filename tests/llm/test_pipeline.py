from __future__ import annotations

import corpus_pipeline

from binsift.llm import decontaminate, near
from binsift.llm._spark import table


def test_stages_keep_the_columns_and_take_effect(spark, small):
    docs = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small).cache()
        assert after.columns == corpus_pipeline.COLUMNS
        assert set(r.doc_id for r in after.select("doc_id").collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())
        if name == "line_dedup":
            assert after.filter("length(text) != n_chars").count() == 0
        if name == "ngram_jaccard_join":
            assert near.join(after).filter("n_links > 0").count() == 0
        if name == "benchmark_decontamination":
            assert decontaminate.contaminated(after, table(spark, small, "benchmark")).count() == 0
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.filter("exact").count() == docs.count()


def test_run_is_the_stages_one_after_another(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.count() > 100 and got.filter("NOT exact").count() == 0


def test_stages_of_defined_cases(spark, small, clashing, docs):
    rows = [(None, "the dog and the cat"), (1, None), (2, ""), (3, "the dog and the cat"), (3, "the dog and the cat"), (4, "of the and a " * 30_000)]
    ids = {
        "language_id": [3, 3, 4, None],  # null and empty texts are of no language
        "line_dedup": [1, 2, 3, 3, 4, None],
        "ngram_jaccard_join": [1, 2, 3, 4],  # one row of the equal ones, texts without words all
        "benchmark_decontamination": [1, 2, 3, 3, 4, None],
        "sentencepiece": [1, 2, 3, 3, 4, None],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clashing(rows), small)
        assert sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x)) == ids[name], name
        assert stage(spark, docs([]), small).count() == 0, name


def test_rows_of_one_id_are_judged_apart(spark, small, docs):
    """A bad text doesn't take a good one of its id, null or not, with it."""
    from binsift.llm._spark import table

    item = table(spark, small, "benchmark").filter("length(text) > 60").first().text
    good = "the river and the house stood in the old garden of the town "
    rows = [(1, "123 456"), (1, good + "one"), (None, "!!"), (None, good + "two"), (2, f"start {item} end"), (2, good + "three and more of it all")]
    kept = {r.text for r in corpus_pipeline.identify_language(spark, docs(rows), small).collect()}
    assert kept == {t for _, t in rows if any(c.isalpha() for c in t)}
    kept = {r.text for r in corpus_pipeline.decontaminate_benchmark(spark, docs(rows), small).collect()}
    assert kept == {t for _, t in rows if item not in t}


def test_run_against_brute_force(spark, small):
    """The whole pipeline over the small tables, stage by stage in plain Python."""
    from test_lines import brute as brute_lines
    from test_near import brute as brute_near

    from binsift.llm._text import WORD_RE

    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    left = {k: t for k, t in docs.items() if t and any(c.isalpha() for c in t)}  # no small text mixes languages evenly
    cut = brute_lines(list(left.items()))
    left = {k: t for k, t in cut.items() if t == left[k] or t.replace("\n", "").strip(" ")}
    groups = brute_near(list(left.items()))
    left = {k: t for k, t in left.items() if groups[k][1] == k}
    items = [" ".join(WORD_RE.findall(r.text.lower())) for r in table(spark, small, "benchmark").collect()]
    left = {k: t for k, t in left.items() if not any(f" {i} " in f" {' '.join(WORD_RE.findall(t.lower()))} " for i in items if i)}
    got = {r.doc_id for r in corpus_pipeline.run(spark, small).select("doc_id").collect()}
    assert got == set(left)
