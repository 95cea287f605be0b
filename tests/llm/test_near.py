from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binsift.llm import graph, near
from binsift.llm._spark import saved
from binsift.llm._text import WORD_RE
from binsift.llm.graph import components


def sets(texts):
    out = {}
    for k, t in texts.items():
        w = WORD_RE.findall((t or "").lower())
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute(rows):
    """n_links and group of every document by all pairs."""
    s = sets(dict(rows))
    ids = sorted(s)
    links, root = {k: 0 for k in ids}, {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (links[k], find(k)) for k in ids}


def family(draw, n, edits):
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(5000)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(docs):
    draw = random.Random(2)
    texts = family(draw, 40, 3) + family(draw, 12, 1) + [" ".join(f"u{draw.randrange(9999)}" for _ in range(50)) for _ in range(30)]
    texts += [texts[0]] * 5 + ["one two", "one two", "One, two!", "", "   ", None]
    rows = list(enumerate(texts))
    wanted = brute(rows)
    for block in (near.BLOCK, 5):
        got = {r.doc_id: (r.n_links, r.group_id) for r in near.join(docs(rows), block=block).collect()}
        assert got == wanted


def test_long_sets_are_counted_by_ranges(docs, monkeypatch):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    parts = [np.unique(np.concatenate((draw.choice(base, draw.integers(2400, 2900), replace=False), draw.integers(0, 1 << 63, 20, dtype=np.uint64)))) for _ in range(12)]
    n = np.array([len(x) for x in parts])
    wanted = [[i != j and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for j, y in enumerate(parts)] for i, x in enumerate(parts)]
    for size in (near.PASS_GRAMS, 1000):
        monkeypatch.setattr(near, "PASS_GRAMS", size)
        assert near.linked(n, parts, 0.8).tolist() == wanted
    monkeypatch.setattr(near, "BLOCK_GRAMS", 500)  # groups are dealt by their n-grams too
    rows = list(enumerate(family(random.Random(4), 30, 3)))
    assert {r.doc_id: (r.n_links, r.group_id) for r in near.join(docs(rows)).collect()} == brute(rows)


def test_equal_texts_are_one_class(docs):
    got = {r.doc_id: r for r in near.join(docs([(3, "a b c d e f"), (9, "A b, c d e f"), (11, "x")])).collect()}
    assert got[9].class_id == 3 and got[9].n_links == 1 and got[11].n_links == 0


def test_defined_results(docs, clashing):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, "word " * 60_000), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f")]
    got = near.join(clashing(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.group_id) for r in got} == {(None, 4), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}
    assert {r.n_links for r in got if r.group_id == 4} == {3}
    assert near.join(docs([])).count() == 0
    kept = near.one_of_each(clashing(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4] and "comp" in kept.columns
    assert near.one_of_each(docs([(None, "a b"), (None, "a b"), (None, "c d")])).count() == 2
    assert near.one_of_each(docs([])).count() == 0


def by_row(rows):
    """(doc_id, n_links, group_id) of rows that may repeat ids, by all pairs of rows."""
    found = brute(list(enumerate(t for _, t in rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            root = found[k][1]
            least[root] = min(i, least.get(root, i))
    return sorted(((i, found[k][0], least.get(found[k][1])) for k, (i, _) in enumerate(rows)), key=repr)


def test_rows_that_repeat_ids_with_one_text_or_several(docs):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (None, b + " y"), (None, "none like it at all here"), (8, a), (8, a)]
    draw = random.Random(9)
    rows += [(draw.randrange(20, 30), t) for t in family(draw, 25, 2) + family(draw, 10, 1)]
    got = near.join(docs(rows))
    assert sorted(((r.doc_id, r.n_links, r.group_id) for r in got.collect()), key=repr) == by_row(rows)
    kept = near.one_of_each(docs(rows))
    groups = {root for _, root in brute(list(enumerate(t for _, t in rows))).values()}
    assert kept.count() == len(groups) and near.join(kept).filter("n_links > 0").count() == 0


def test_a_long_chain_of_unlike_texts(docs):
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(80)]
    wanted = brute(rows)
    for block in (near.BLOCK, 8):
        got = {r.doc_id: (r.n_links, r.group_id) for r in near.join(docs(rows), block=block).collect()}
        assert got == wanted


def test_recall_at_the_threshold(docs):
    """Pairs of a similarity just above the threshold, each pair by itself."""
    draw, rows = random.Random(12), []
    for k in range(400):
        w = [f"p{k}x{j}" for j in range(94)]  # 90 n-grams; one changed word at 10 from an end spoils 5, two 10
        v = list(w)
        v[20], v[60] = "changed", "too"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    draw.shuffle(rows)
    s = sets(dict(rows))
    assert 0.8 <= len(s[0] & s[1]) / len(s[0] | s[1]) < 0.81
    found = near.join(docs(rows)).filter("n_links = 1").count() / 800
    assert found >= 0.985


def test_band_plan_reaches_its_recall():
    for threshold, recall in ((0.8, 0.997), (0.5, 0.99), (0.9, 0.9999)):
        bands, rows = near.band_plan(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= near.HASHES


def test_signatures_agree_as_often_as_the_sets_are_alike():
    draw = np.random.default_rng(0)
    same = 0
    for _ in range(60):
        common, a, b = draw.integers(0, 1 << 63, 160, dtype=np.uint64), draw.integers(0, 1 << 63, 20, dtype=np.uint64), draw.integers(0, 1 << 63, 20, dtype=np.uint64)
        x, y = near.band_hashes(np.concatenate((common, a)), 64, 1), near.band_hashes(np.concatenate((common, b)), 64, 1)
        same += int((x == y).sum())
    assert abs(same / (60 * 64) - 0.8) < 0.03


def test_components_of_chains_stars_and_self_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (300, 301), (None, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 3, 1 << 15])
def test_few_edges_are_contracted_in_one_task(spark, monkeypatch, few):
    written = []
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "saved", lambda df: written.append(df) or saved(df))
    edges = [(i, i + 1) for i in range(40)] + [(50, 50), (60, 61), (62, 61), (62, 60), (None, 3)]
    rows = spark.createDataFrame(edges, "a long, b long").selectExpr("named_struct('hi', a % 2, 'lo', a) AS u", "CASE WHEN a IS NOT NULL THEN named_struct('hi', b % 2, 'lo', b) END AS v")
    rows = rows.withColumn("u", F.when(F.col("v").isNotNull(), F.col("u")))
    got = {tuple(r.node): tuple(r.comp) for r in components(rows).collect()}
    name = lambda x: (x % 2, x)
    want = {name(i): name(0) for i in range(41)} | {name(50): name(50)} | {name(i): name(60) for i in (60, 61, 62)}
    assert got == want
    assert few < 1 << 15 or len(written) == 4
