from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from binsift.operators import vectors

STORE, ASKED = "store_id long, stored array<double>", "id long, vector array<double>"


def nearest(asked, store, least, block=2000, seen=None):
    return vectors.search(asked, vectors.index(store), least, block, seen)


def test_defined_cases(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0])], STORE)
    asked = store.select(F.col("store_id").alias("id"), F.col("stored").alias("vector"))
    for block in (2000, 2):
        got = {r.id: (r.store_id, r.cos) for r in nearest(asked, store, 0.5, block).collect()}
        assert got == {1: (2, 1.0), 2: (1, 1.0)}
    got = nearest(spark.createDataFrame([(9, [3.0, 0.0])], ASKED), store.repartition(5), 0.9).collect()
    assert [(r.id, r.store_id) for r in got] == [(9, 1)]  # of equal ones the least id
    assert nearest(asked.limit(0), store, 0.5).count() == 0 and nearest(asked, store.limit(0), 0.5).count() == 0


def brute(rows, asked, least):
    ids, v = np.array([i for i, _ in rows]), vectors.units(np.array([x for _, x in rows]))
    out = {}
    for i, x in asked:
        cos = np.floor(v @ vectors.units(np.array([x]))[0] * 1e6 + 0.5) / 1e6
        cos[ids == i] = -2
        best = cos.max()
        if best >= least:
            out[i] = (int(ids[cos == best].min()), float(best))
    return out


@pytest.mark.parametrize(("clusters", "spread", "share"), [(30, 0.05, 0.15), (8, 0.4, 1.0), (1, 5.0, 1.0)])
def test_equals_all_pairs(spark, monkeypatch, clusters, spread, share):
    monkeypatch.setattr(vectors, "PER_CELL", 20)
    rng = np.random.default_rng(clusters)
    middles = rng.normal(size=(clusters, 12))
    rows = [(i, (middles[rng.integers(clusters)] + spread * rng.normal(size=12)).tolist()) for i in range(1200)]
    rows += [(2000 + i, x) for i, (_, x) in enumerate(rows[:150])] + [(3000 + i, rows[0][1]) for i in range(100)]  # repeated, and a hot one
    asked = rows[::9]
    seen = vectors.Searched()
    got = nearest(spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, STORE).repartition(3), 0.2, 60, seen)
    assert {r.id: (r.store_id, r.cos) for r in got.collect()} == brute(rows, asked, 0.2)
    assert 0 < seen.pairs <= share * seen.of and seen.of == len(asked) * len(rows)
