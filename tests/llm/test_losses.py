"""What the classifiers minimise, by loops over pairs and sentences."""

from __future__ import annotations

import math
import random

import numpy as np

from binsift.llm import quality, toxicity


def documents(seed, n, words):
    rng = random.Random(seed)
    return [". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def pair_loss(w, pairs, decay=1e-4):
    """Mean logistic loss of preferring the first of each pair, and the decay."""
    return sum(math.log1p(math.exp(-float(w @ d))) for d in pairs) / len(pairs) + decay / 2 * float(w @ w)


def test_pairwise_loss_is_at_its_minimum():
    good = documents(1, 25, "the river house stands near old green hills with light and many people walking there".split())
    poor = documents(2, 25, "BUY now $$$ click 1234 WIN the the the river".split()) + good[:10]  # some of them can't be told
    rows = [(t, 1) for t in good] + [(t, 0) for t in poor]
    m = quality.fit(rows, pairs=400, rounds=4000)
    z = (np.array([quality.features(t) for t, _ in rows]) - m.mean) / m.scale
    draw = np.random.default_rng(4)
    first, second = draw.choice(np.arange(25), 400), draw.choice(np.arange(25, 60), 400)
    pairs = [z[a] - z[b] for a, b in zip(first, second)]
    at = pair_loss(m.weights, pairs)
    assert at < 0.9 * math.log(2)
    for k in range(len(m.weights)):  # slopes by differences
        step = np.zeros_like(m.weights)
        step[k] = 1e-4
        assert abs(pair_loss(m.weights + step, pairs) - pair_loss(m.weights - step, pairs)) / 2e-4 < 2e-2
    rng = np.random.default_rng(5)
    assert all(pair_loss(m.weights + 0.5 * rng.normal(size=len(m.weights)), pairs) > at - 1e-3 for _ in range(30))


def plain_score(m, text):
    """Noisy-or over sentences of the logistic of the summed weights of their distinct words."""
    none = 1.0
    for s in toxicity.SENTENCE.findall(text.lower()):
        words = set(toxicity.WORD.findall(s))
        if words:
            z = m.bias + sum(float(m.weights[toxicity.features(w)].sum()) for w in words)
            none *= 1 - 1 / (1 + math.exp(-max(-700.0, min(z, 30.0))))
    return 1 - none


def noisy_or_loss(m, rows):
    """Weighted log loss of documents, both labels alike."""
    out = {0: 0.0, 1: 0.0}
    for text, y in rows:
        p = min(max(plain_score(m, text), 1e-9), 1 - 1e-9)
        out[y] -= math.log(p if y else 1 - p)
    return out[1] / sum(y for _, y in rows) + out[0] / sum(1 - y for _, y in rows)


def test_noisy_or_loss_falls_and_scores_are_those_of_loops(spark):
    clean = documents(3, 60, "the river house stands near old green hills with light and many people walking there".split())
    bad = [t + ". you stupid awful moron go away. " + u for t, u in zip(documents(4, 60, "the river house near hills light people".split()), clean)]
    rows = [(t, 1) for t in bad] + [(t, 0) for t in clean]
    losses = [noisy_or_loss(toxicity.fit(rows, rounds=n), rows) for n in (1, 10, 60)]
    assert losses[0] > losses[1] > losses[2]
    m = toxicity.fit(rows)
    texts = ["the river. you stupid moron. the hills", "the river house", "", "stupid", "...", "Moron! MORON moron"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.score, [(s["start"], s["end"]) for s in r.sentences]) for r in toxicity.score(df, m).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i][0] - plain_score(m, t)) < 1e-6
    assert got[0][1] == [(10, 27)] and got[1][1] == [] and got[0][0] > 0.7 > 0.3 > got[1][0]
