from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from binsift.llm import suffix


def brute(rows, n=suffix.LENGTH):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + n] for _, r in raws for k in range(len(r) - n + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted([tuple(r)[:5] for r in suffix.dedup(df).collect()], key=repr)


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))


def corpus():
    draw = random.Random(3)
    passages = [words(draw, 60) for _ in range(3)]
    rows = [words(draw, 40) for _ in range(12)]
    rows += [f"{words(draw, 10)} {draw.choice(passages)[draw.randint(0, 60):]} {words(draw, 10)}" for _ in range(25)]
    rows += [rows[0]] * 3 + ["ab" * 400, "é" * 300, passages[0][:200], passages[0][:199], "", None, "x" * 200, "x" * 201]
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_against_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = corpus()
    assert result(docs(rows)) == sorted(brute(rows), key=repr)


def test_defined_results(docs, clashing):
    text = words(random.Random(4), 50)
    rows = [(None, text), (1, text), (1, text), (2, None), (3, "short"), (3, "other short"), (4, words(random.Random(5), 60_000))]
    assert result(clashing(rows)) == sorted(brute(rows), key=repr)
    assert result(docs([])) == []


def test_anchors_of_equal_strings_stand_at_equal_places():
    draw = random.Random(6)
    for _ in range(20):
        string = bytes(draw.choice(b"ab ") for _ in range(suffix.LENGTH))
        a, b = (bytes(draw.choice(b"abc ") for _ in range(draw.randint(0, 300))) for _ in range(2))
        one, two = a + string + b, b + string
        inside = lambda raw, start: {int(p) - start for p in suffix.anchors(raw)[0] if start <= p <= start + suffix.LENGTH - suffix.ANCHOR}
        assert inside(one, len(a)) & inside(two, len(b))


def test_suffix_sort_and_common_prefixes():
    draw = random.Random(7)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(300)]
    group = np.sort(np.array([draw.randrange(20) for _ in strings]))
    order, common = suffix.Suffixes(strings, group).sort()
    assert [(group[k], strings[k]) for k in order] == sorted(zip(group.tolist(), strings))
    for a, b, n in zip(order, order[1:], common[1:]):
        assert n == (suffix.Suffixes._bytes_common(strings[a], strings[b]) if group[a] == group[b] else -1)


def test_colliding_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(suffix, "prefix_hash", lambda data: np.zeros(len(data) + 1, dtype=np.uint64))
    strings = [b"b", b"a", b"ab", b"", b"a"]
    order, common = suffix.Suffixes(strings, np.zeros(5, dtype=np.int64)).sort()
    assert [strings[k] for k in order] == sorted(strings) and common.tolist() == [-1, 0, 1, 1, 0]


def test_many_copies_of_one_row_cost_in_proportion(docs):
    text = words(random.Random(8), 3000)
    rows = [(i, t) for i, t in [(1, text)] * 500 + [(None, text)] * 300 + [(2, text[:5000])] * 200]
    start = time.monotonic()
    got = result(docs(rows))
    assert len(got) == 1000 and all(r[2] == r[1] for r in got)
    assert time.monotonic() - start < 60


def test_null_ids_of_many_texts(docs):
    draw = random.Random(10)
    shared = words(draw, 80)
    rows = [(None, f"{words(draw, 20)} {shared if k % 3 else ''} {words(draw, 20)}") for k in range(60)]
    assert result(docs(rows)) == sorted(brute(rows), key=repr)


def test_long_texts_of_few_bytes(docs, monkeypatch):
    """Every place is an anchor and all are hot; equal contexts are counted once."""
    monkeypatch.setattr(suffix, "HOT", 50)
    rows = list(enumerate(["a" * 3000, "ab" * 1200, "abc" * 700 + "x" + "abc" * 100, "b" * 150, "q" * 199 + "ab" * 150]))
    assert result(docs(rows)) == sorted(brute(rows), key=repr)
    begun = time.time()
    assert [(r.n_bytes, r.n_removed) for r in suffix.dedup(docs([(1, "a" * 1_000_000)])).collect()] == [(1_000_000, 1_000_000)]
    assert time.time() - begun < 60
