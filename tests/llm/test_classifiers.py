from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binsift.llm import language, quality, toxicity
from binsift.llm._spark import sample_of_labels, table, texts_of
from binsift.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def marks(spark, name, label, sf_dir=MEDIUM):
    """(held out, score, predicted, label) of the labelled documents."""
    got = QUERIES[name](spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "documents").count()
    return [(r.held_out, r.score, r.predicted, r[label]) for r in got.join(table(spark, sf_dir, "labels").select("doc_id", label), "doc_id").collect()]


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_classifier", "quality", 0.97), ("op5_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    rows = marks(spark, name, label)
    held = [r for r in rows if r[0]]
    assert len(held) > 20 and all(0 <= r[1] <= 1 for r in rows)
    assert np.mean([r[2] == r[3] for r in held]) >= least


def test_held_out_languages(spark):
    got = QUERIES["op7_language_id"](spark, MEDIUM).join(table(spark, MEDIUM, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(got) == 1000 and np.mean(held) >= 0.98


def test_scores_ignore_labels_and_other_columns(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good plain words here. " if i % 2 else "BAD!!! ### ### $$$ ") * 5) for i in range(40)]
    plain, other = docs(rows), docs(rows).withColumn("lang", F.lit("zz")).withColumn("source", F.col("doc_id").cast("string"))
    for module in (quality, toxicity):
        a = {r.doc_id: r.score for r in module.classify(plain, labels).collect()}
        b = {r.doc_id: r.score for r in module.classify(other, labels).collect()}
        assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_defined_results(spark, docs, clashing, module):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "word " * 60_000), (4, "one. two"), (4, "one. two")]
    none = spark.createDataFrame([(None, None, None), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = module.classify(clashing(rows), none).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert module.classify(docs([]), none).count() == 0
    assert module.classify(docs([]), none.limit(0)).count() == 0


def test_bags_find_their_offending_sentences():
    draw = random.Random(1)
    clean = lambda: " ".join(draw.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(6))
    rows = [(". ".join(clean() for _ in range(5)), 0) for _ in range(200)]
    rows += [(". ".join([clean(), clean() + " vilewort " + clean(), clean()]), 1) for _ in range(200)]
    m = toxicity.fit(rows)
    found = toxicity.sentence_scores("sun moon. tree vileworts stone. river", toxicity._Weights(m.weights), m.bias)
    assert [p > 0.5 for _, _, p in found] == [False, True, False]
    whole = 1 - np.prod([1 - p for _, _, p in found])
    assert whole > 0.7


def test_pairs_rank_good_above_poor():
    good, poor = "The cat sat on the mat. It was warm there, and quiet.", "BUY!!! ### NOW $$$ BUY!!! ### NOW $$$"
    m = quality.fit([(good + f" {i}", 1) for i in range(50)] + [(poor + f" {i}", 0) for i in range(20)])
    raw = m.raw(np.array([quality.features(good), quality.features(poor)]))
    assert raw[0] > raw[1]


def test_the_cut_is_the_quantile_of_all_labelled_rows(spark, docs):
    """Empty and very long rows have no part in the fit and count in the quantile."""
    good, poor = "The cat sat on the mat. It was warm there, and quiet.", "BUY!!! ### NOW $$$ BUY!!! ### NOW $$$"
    rows = [(i, good + f" {i} ") for i in range(60)] + [(100 + i, poor + f" {i} ") for i in range(10)] + [(200 + i, "") for i in range(10)] + [(300 + i, (poor + " ") * 800) for i in range(10)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    got = quality.classify(docs(rows), labels).collect()
    learn = [r for r in got if not r.held_out]
    share = np.mean([r.doc_id >= 100 for r in learn])
    order = sorted(r.raw for r in learn)
    cut = order[int(np.ceil(share * len(order))) - 1]
    assert all(r.predicted == (r.raw >= cut) for r in got)
    assert np.mean([r.predicted == (r.doc_id < 100) for r in got]) > 0.85


def test_repeated_ids_teach_one_text_and_count_each_label_once(spark, docs):
    rows = docs([(1, f"text {k}") for k in range(50)] + [(2, "other"), (2, None), (3, "")])
    got = texts_of(rows, [(1, 0), (2, 1), (3, 1)], 100)
    assert [label for _, label in got] == [0, 1] and got[1][0] == "other" and got[0][0].startswith("text ")
    assert texts_of(rows.repartition(5), [(1, 0), (2, 1), (3, 1)], 100) == got
    scored = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)], "doc_id long, raw double")
    once = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    often = once.unionByName(once.filter("doc_id = 4").crossJoin(spark.range(20).select()))
    assert quality.cut_at(scored, often) == quality.cut_at(scored, once) == 0.0


def test_compression_is_of_the_whole_text():
    draw = random.Random(2)
    start = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz .,") for _ in range(1 << 20))
    alone, whole = quality.features(start), quality.features(start + "spam " * 1_500_000)
    assert alone[10] > 0.5 and alone[12] == 0.0
    assert whole[10] < 0.1 and whole[11] < 0.1 and whole[12] == 1.0


def model():
    rows = [("the cat and the dog are in the house with a ball", "en"), ("der hund und die katze sind in dem haus mit einem ball", "de"), ("это очень хороший дом и большая собака", "ru"), ("добър ден на всички приятели", "bg")]
    return language.fit(rows * 30)


def test_spans_of_mixed_text():
    words = language.Words(model())
    text = "the dog and the cat are in the house der hund und die katze sind in dem haus mit einem ball und"
    lang, score, spans = language.label(text, words, penalty=4.0)
    assert lang == "de" and [s[2] for s in spans] == ["en", "de"] and 0 < score < 1
    assert text[spans[1][0] :].startswith("der hund")


def test_script_narrows_the_candidates():
    words = language.Words(model())
    assert language.label("большая собака", words)[0] == "ru"
    row = words.scores[words["дом"]]
    assert row[words.m.langs.index("en")] == -language.BARRED and row[words.m.langs.index("ru")] > -language.MOST
    spans = language.label("the dog and the cat дом are in the house with the ball", words)[2]
    assert [s[2] for s in spans] in (["en", "ru", "en"], ["en", "bg", "en"])
    assert language.label("λόγος", words)[1] > 0  # a script no language was learned in: all alike, the first wins


def test_shortcut_gives_the_path_of_the_recurrence():
    draw = np.random.default_rng(5)

    def best(scores, penalty):
        """Greatest path score by all paths."""
        n, k = scores.shape
        paths = np.indices((k,) * n).reshape(n, -1).T
        value = scores[np.arange(n), paths].sum(1) - penalty * (np.diff(paths, axis=1) != 0).sum(1)
        return value.max()

    for _ in range(60):
        scores, penalty = draw.normal(0, 2, (7, 3)), float(draw.uniform(0, 6))
        path = language.viterbi(scores, penalty)
        got = scores[np.arange(7), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert abs(got - best(scores, penalty)) < 1e-9
        sums = np.cumsum(scores, axis=0)
        top = int(np.argmax(sums[-1]))
        gain = np.vstack((np.zeros((1, 3)), sums - sums[:, top : top + 1]))
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
            assert abs(sums[-1, top] - best(scores, penalty)) < 1e-9


def test_languages_of_defined_cases(docs, clashing):
    rows = [(0, None, "en"), (1, "", "en"), (2, "123 !!", "en"), (3, "the house and the dog " * 20_000, "en"), (4, "the house and the dog", "en"), (5, "das haus und der hund", "de"), (5, "das haus und der hund", "de"), (None, "the dog", None)]
    m = language.train(clashing(rows))
    got = {(r.doc_id, r.lang_pred) for r in language.identify(clashing(rows), m).collect()}
    assert got == {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "en"), (5, "de"), (None, "en")}
    empty = language.classify(docs([]))
    assert empty.count() == 0
    assert language.label("the dog", language.Words(language.fit([]))) == ("und", 0.0, [])


def test_every_language_is_learned(docs):
    letters = "abcdefghijklmnop"
    word = lambda k: letters[k // 16] + letters[k % 16] + "zzq"
    rows = [(2 * k + j, f"{word(k)} {word(k)}", f"l{k:02}") for k in range(70) for j in range(2)]
    m = language.train(docs(rows))
    assert m.langs == [f"l{k:02}" for k in range(70)]
    words = language.Words(m)
    assert all(language.label(f"{word(k)} {word(k)}", words)[0] == f"l{k:02}" for k in range(70))


def test_a_language_of_long_texts_is_learned(docs):
    rows = [(0, "the house and the dog", "en"), (1, "1 " * 20_000 + "das haus und der hund " * 2_000, "de"), (2, "das haus " * 10_000, "de"), (3, "12", "de")]
    m = language.train(docs(rows))
    assert m.langs == ["de", "en"] and language.label("und der hund", language.Words(m))[0] == "de"


def test_repeated_ids_leave_room_for_other_languages(docs):
    rows = [(7, f"the house {k}", "en") for k in range(200)] + [(k, "das haus und der hund", "de") for k in range(3)]
    assert language.train(docs(rows), rows_per_lang=20).langs == ["de", "en"]


def test_word_scores_against_their_definition():
    """Log-likelihoods of the trigrams between a word's ends and of the word, by counting."""
    rows = [("ab abc ab", "x"), ("abd ab dd", "y"), ("cab", "x")]
    m = language.fit(rows)
    of = lambda w: [f"<{w}>"[i : i + 3] for i in range(len(w))] + [f"<{w}>"]
    counts = {lang: [g for t, k in rows if k == lang for w in t.split() for g in of(w)] for lang in "xy"}
    vocabulary = set(counts["x"]) | set(counts["y"])
    for word in ("ab", "abc", "dd", "zz", "cab"):
        wanted = np.zeros(2)
        for g in of(word):
            if g in vocabulary:
                logs = np.array([np.log((counts[lang].count(g) + 0.5) / (len(counts[lang]) + 0.5 * len(vocabulary))) for lang in "xy"])
                wanted += (logs - logs.mean()) / 3
        words = language.Words(m)
        assert np.allclose(words.scores[words[word]], np.clip(wanted, -language.MOST, language.MOST))


def test_scripts_of_words():
    for word, name in {"dog": "latin", "été": "latin", "дом": "cyrillic", "λόγος": "greek", "漢字": "han", "かな": "han", "한국": "hangul", "שלום": "hebrew", "سلام": "arabic", "नमस्ते": "devanagari"}.items():
        assert language.script(word) == name


def test_caches_keep_no_long_words():
    words = language.Words(model())
    for k in range(200):
        language.label("漢" * 50_000 + str(k) + "字" * 50_000, words)
    assert sum(map(len, words)) + sum(map(len, words.old)) < 3 * language.CACHE_CHARS
    w = toxicity._Weights(np.zeros(toxicity.DIMENSIONS, dtype=np.float32))
    w["a" * 1000], w["b"]  # noqa: B018
    assert list(w) == ["b"]


def test_few_and_many_languages_score_alike(monkeypatch):
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choices("abcdefghijklm"[k : k + 9], k=rng.randrange(2, 8))) for _ in range(200)), f"l{k}") for k in range(4)]
    m = language.fit(rows)
    table = m.likelihoods.table()
    assert table is not None and np.allclose(table.mean(1), 0)
    for _ in range(50):
        some = rng.sample(range(len(m.index)), 6)
        assert np.allclose(m.likelihoods.added(some), table[some].sum(0))
    texts = [" ".join(t.split()[:30]) for t, _ in rows] + ["abc xyz"]
    small = [language.label(t, language.Words(m))[:2] for t in texts]
    monkeypatch.setattr(language, "TABLE", 0)
    assert m.likelihoods.table() is None
    large = [language.label(t, language.Words(m))[:2] for t in texts]
    assert [x[0] for x in small] == [x[0] for x in large] == ["l0", "l1", "l2", "l3", large[4][0]] and np.allclose([x[1] for x in small], [x[1] for x in large])


def test_a_model_of_many_languages_is_bounded(monkeypatch):
    monkeypatch.setattr(language, "ALL_GRAMS", 20_000)
    rng = random.Random(4)
    rows = [(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)), f"l{k:03d}") for k in range(200)]
    m = language.fit(rows)
    size = sum(x.nbytes for x in (m.likelihoods.unseen, m.likelihoods.starts, m.likelihoods.of, m.likelihoods.gain, m.likelihoods.shift))
    assert len(m.langs) == 200 and len(m.likelihoods.gain) <= 20_000 and size < 1_000_000


def test_labels_without_a_text_take_no_places_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "" if i < 40 else None if i < 60 else "x" * 30 if i < 80 else f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    drawn = sample_of_labels(docs, labels, "quality", 8, 20)
    assert len(drawn) == 16 and all(80 <= i < 100 and i % 2 == v for i, v in drawn)
    assert len(texts_of(docs, drawn, 20)) == 16
    assert len(sample_of_labels(docs, labels.unionByName(labels), "quality", 50, 20)) == 20
