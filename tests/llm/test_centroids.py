from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from comparing import connection, same_rows

from binsift.llm import centroids
from binsift.llm.queries import ORACLE_SQL, QUERIES

NAME = "op11_centroid_clustering"
COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters=8, rounds=10):
    """The contract, one vector after the other, in Python's integers."""
    vs = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e in rows]
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(v) for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in vs]
        for k in range(len(cs)):
            own = [v for (_, v), c in zip(vs, of) if c == k]
            if own:
                cs[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in vs]
    inertia = {k: sum(d for _, d, c in last if c == k) for k in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((i is None, i or 0, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in last)


def rows_of(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_gives_the_rows_of_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    same_rows(QUERIES[NAME](spark, path), connection(path), ORACLE_SQL[NAME])


def test_ties_repeats_and_hot_ids(spark):
    rng = random.Random(3)
    vs = [[rng.choice((-1.0, 0.0, 1.0)) if j < 2 else 0.0 for j in range(64)] for _ in range(60)]  # few places: ties everywhere
    rows = [(i % 40, v) for i, v in enumerate(vs)] + [(None, vs[0]), (None, vs[1])] + [(7, vs[2])] * 40
    got = centroids.cluster(spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS).repartition(3))
    assert rows_of(got) == plain(rows)


def test_vectors_left_out(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(5)]
    bad = [(10, None), (11, [0.0] * 63), (12, [0.0] * 65), (13, [None] + [0.0] * 63), (14, [float("nan")] * 64), (15, [float("-inf")] + [1.0] * 63), (16, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], COLUMNS)
    for n in ("components", "norms", "cluster", "n", "total", "h", "x"):
        df = df.withColumn(n, df.label)
    assert rows_of(centroids.cluster(df)) == plain(good)
    assert centroids.cluster(df.limit(0)).count() == 0
    assert centroids.cluster(df.filter("vec_id >= 10")).count() == 0
    assert len(centroids.cluster(df.filter("vec_id = 1")).collect()) == 1


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e6] + [0.0] * 63, 0)], COLUMNS)).collect()


def test_screen_is_exact_and_leaves_distances_out():
    rng = np.random.default_rng(5)
    scale = rng.integers(1, 1 << 20, size=(400, 64))
    for v in (rng.integers(-3, 4, size=(400, 64)), rng.integers(-(1 << 26), 1 << 26, size=(400, 64)), scale * (rng.random((400, 64)) < 0.1)):
        c = np.concatenate([v[:5], v[:3]])  # repeated centroids tie
        screen = centroids.Screen(c)
        cluster, d = screen.nearest(v, centroids.norms(v))
        every = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        assert screen.exact < every.size
