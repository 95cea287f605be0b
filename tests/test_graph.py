from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from binsift.operators import graph

FLOW, SEEDS = "fn string, src string, dst string", "fn string, var string"


def chain(spark, n):
    return spark.createDataFrame([("f", f"v{k}", f"v{k + 1}") for k in range(n)], FLOW).coalesce(1)


@pytest.fixture
def one_task(spark):
    """Rounds are many and tiny."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_longest_hops_beyond_a_hundred_steps(spark, one_task):
    got = graph.longest_hops(chain(spark, 103), spark.createDataFrame([("f", "v0")], SEEDS))
    assert {r["var"]: r.hops for r in got.collect()} == {f"v{k}": k for k in range(104)}


def test_taint_goes_on_beyond_four_hundred_steps(spark, one_task):
    got = graph.tainted(chain(spark, 406), spark.createDataFrame([("f", "v0")], SEEDS))
    assert got.count() == 407


def test_aliases_beyond_a_hundred_steps(spark, one_task):
    got = graph.aliases(chain(spark, 103), spark.createDataFrame([("f", "v0", 1)], f"{SEEDS}, position int"))
    assert got.count() == 104


def test_an_alias_of_a_lesser_position_goes_on(spark, one_task):
    moves = spark.createDataFrame([("f", "q", "b"), ("f", "b", "c"), ("f", "p", "a"), ("f", "a", "a2"), ("f", "a2", "b")], FLOW)
    got = graph.aliases(moves, spark.createDataFrame([("f", "p", 0), ("f", "q", 1)], f"{SEEDS}, position int"))
    assert {r["var"]: r.position for r in got.collect()} == {"p": 0, "a": 0, "a2": 0, "b": 0, "c": 0, "q": 1}


def test_a_chain_of_eight_thousand_moves_takes_thirteen_rounds(spark, one_task, monkeypatch):
    rounds, doubled = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, by=None: rounds.append(1) or doubled(df, by))
    params = spark.createDataFrame([("f", "v0", 1), ("f", "v4000", 0)], f"{SEEDS}, position int")
    got = {r["var"]: r.position for r in graph.aliases(chain(spark, 8000), params).collect()}
    assert got == {f"v{k}": int(k < 4000) for k in range(8001)}
    assert len(rounds) <= 14 + 10  # doubled 13 times and once to see that it is done; the rest are tables made once
    assert {r["var"]: r.hops for r in graph.longest_hops(chain(spark, 8000), params.filter("position = 0")).collect()} == {f"v{k}": k - 4000 for k in range(4000, 8001)}


def plain_settled(edges, own, least, step):
    """Relaxed until nothing changes; None where that has no end."""
    best = min if least else max
    x = {}
    for f, v, k in own:
        x[f, v] = best(k, x.get((f, v), k))
    for _ in range(3 * len(edges) + 3):
        new = dict(x)
        for f, a, b in edges:
            if (f, a) in x and (step or a != b):
                new[f, b] = best(x[f, a] + step, new.get((f, b), x[f, a] + step))
        if new == x:
            return x
        x = new
    return None


@pytest.mark.parametrize("seed", range(4))
def test_settled_against_relaxation(spark, one_task, seed):
    """Chains with merges, cycles of both kinds and cycles that nothing reaches, in several functions."""
    rng = random.Random(seed)
    edges = []
    for f in "abc":
        n = rng.randrange(4, 14)
        for v in range(1, n):
            for u in rng.sample(range(v), min(v, 1 if rng.random() < (0.85 if seed % 2 else 0.4) else 2)):
                edges.append((f, f"v{u}", f"v{v}"))
        if seed % 4 == 1:
            edges += [(f, f"v{n - 1}", f"v{rng.randrange(n)}")]
        edges += [(f, "x1", "x2"), (f, "x2", "x1"), (f, "x2", "x3"), (f, "x3", "x4")]
    own = [(f, f"v{rng.randrange(4)}", rng.randrange(5)) for f in "abb" for _ in range(2)] + ([("a", "x3", 2)] if seed < 2 else [("c", "x2", 1), ("a", "lone", 4)])
    df, values = spark.createDataFrame(edges + edges[:3], FLOW), spark.createDataFrame(own, f"{SEEDS}, x int")
    for least, step in ((True, 0), (False, 1)):
        want = plain_settled(edges, own, least, step)
        if want is None:
            with pytest.raises(ValueError, match="cycle"):
                graph.settled(df, values, least, step).collect()
        else:
            assert {(r.fn, r["var"]): r.x for r in graph.settled(df, values, least, step).collect()} == want


@pytest.mark.parametrize("least,step", [(True, 0), (False, 1)])
def test_settled_in_tasks_as_in_rounds(spark, one_task, monkeypatch, least, step):
    """All functions where they are, the longer one in rounds, and both; short ones take no rounds."""
    edges = [("f", f"v{k}", f"v{k + d}") for k in range(9) for d in (1, 2)] + [("g", "a", "b"), ("g", "b", None), ("g", "z", "y"), (None, "a", "b")]
    own = [("f", "v1", 3), ("f", "v4", 0), ("f", "v4", 2), ("g", "a", 1), ("h", "lone", 5)]
    df, values = spark.createDataFrame(edges, FLOW), spark.createDataFrame(own, f"{SEEDS}, x int")
    want = plain_settled([e for e in edges if None not in e], own, least, step)
    for most in (100, 10, 0):
        written, kept = [], graph.saved
        with monkeypatch.context() as m:
            m.setattr(graph, "saved", lambda df, by=None: written.append(1) or kept(df, by))
            got = graph.settled(df, values, least, step, most=most)
        assert sorted((r.fn, r["var"], r.x) for r in got.collect()) == sorted((*k, x) for k, x in want.items())
        assert got.schema["x"].dataType == values.schema["x"].dataType
        assert (len(written) == 1) == (most == 100)


def test_levels_beyond_twenty(spark, one_task):
    edges = chain(spark, 23).selectExpr("src AS caller", "dst AS callee")
    for small in (100_000, 5):
        assert {r.node: r.level for r in graph.levels(edges, small).collect()} == {f"v{k}": 23 - k for k in range(24)}


def test_levels_of_cycles_and_repeated_edges(spark, one_task):
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "c"), ("s", "s"), ("t", "c")]
    edges = spark.createDataFrame(rows, "caller string, callee string")
    for small in (100_000, 3):
        got = {r.node: r.level for r in graph.levels(edges, small).collect()}
        assert got == {"c": 0, "b": 1, "t": 1, "a": 2, "x": None, "y": None, "z": None, "s": None}


def plain_levels(edges):
    """Peeled one node after the other; None on and above cycles."""
    left, out = {n: {b for a, b in edges if a == n} for e in edges for n in e}, {}
    while ready := [n for n, to in left.items() if n not in out and all(b in out for b in to)]:
        out.update({n: max((out[b] + 1 for b in left[n]), default=0) for n in ready})
    return {n: out.get(n) for n in left}


@pytest.mark.parametrize("small,fill,cycles", [(0, 64, 0), (12, 64, 4), (0, 0, 1), (3, 1, 4)])
def test_levels_by_taking_out_nodes_against_peeling(spark, one_task, small, fill, cycles):
    """Down to nothing, to what the driver peels, not at all, and as far as few rows go."""
    rng = random.Random(fill)
    edges = [(f"n{a:02}", f"n{b:02}") for a, b in (sorted(rng.sample(range(14), 2)) for _ in range(22))]
    edges += [("n03", "n03"), ("n09", "n02"), ("n13", "n12"), ("n12", "n13")][:cycles] + edges[:2]
    got = [tuple(r) for r in graph.levels(spark.createDataFrame(edges, "caller string, callee string"), small, fill).collect()]
    assert sorted(got) == sorted(plain_levels(edges).items())


def test_levels_around_few_that_all_call_take_one_step(spark, one_task, monkeypatch):
    written, kept = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, by=None: written.append(1) or kept(df, by))
    core = [f"c{k:02}" for k in range(30)]
    edges = list(zip(core, core[1:])) + [(f"c{k:02}", f"m{k}_{i}") for k in range(29) for i in range(4)] + [(f"m{k}_{i}", f"c{k + 1:02}") for k in range(29) for i in range(4)]
    got = graph.levels(spark.createDataFrame(edges, "caller string, callee string"), 40)
    assert {r.node: r.level for r in got.collect()} == plain_levels(edges)
    assert len(written) <= 10  # not two for each of the 59 levels


def test_a_cycle_has_no_longest_path(spark, one_task):
    flow = spark.createDataFrame([("f", "a", "b"), ("f", "b", "a")], FLOW)
    seeds = spark.createDataFrame([("f", "a")], SEEDS)
    assert graph.tainted(flow, seeds).count() == 2
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_hops(flow, seeds)


def test_distances_go_as_far_as_edges_lead(spark, one_task):
    edges = chain(spark, 30).selectExpr("src AS caller", "dst AS callee")
    seeds = spark.createDataFrame([("v30",)], "node string")
    assert graph.distances(edges, seeds, backwards=True).count() == 31 and graph.distances(edges, seeds, 10, backwards=True).count() == 11
    assert graph.reachable(edges, F.col("node") == "v30", F.lit(False)).count() == 31


def test_rounds_of_page_rank_hold_nodes_with_callers_only(spark, one_task, monkeypatch):
    written, kept = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, by=None: written.append(kept(df, by)) or written[-1])
    pairs = [(f"n{k}", "a") for k in range(20)] + [("a", "b"), ("b", "a"), ("a", "s"), ("n0", "n1")]
    names = sorted({n for p in pairs for n in p})
    own = spark.createDataFrame([("s", 1.0)], "node string, weight double")
    got = {r.node: r["rank"] for r in graph.page_rank(spark.createDataFrame(pairs, "caller string, callee string"), own, rounds=4, cut_every=2).collect()}
    into = {n: sum(b == n for _, b in pairs) for n in names}
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(4):
        rank = {n: 0.85 * sum(rank[b] / into[b] for a, b in pairs if a == n) + (0.15 if n == "s" else 0) for n in names}
    assert got == pytest.approx({n: x / max(rank.values()) for n, x in rank.items()}, abs=1e-4)
    assert [t.count() for t in written if t.columns == ["node", "rank"]] == [4, len(names)]


def test_components_left_by_trimming_are_done_at_once(spark, one_task, monkeypatch):
    def coloured(edges):
        raise AssertionError("few edges need no rounds")

    pairs = [(f"n{k}", "a") for k in range(9)] + [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")]
    edges = spark.createDataFrame(pairs, "caller string, callee string")
    want = {**{f"n{k}": f"n{k}" for k in range(9)}, "a": "b", "b": "b", "c": "d", "d": "d"}
    monkeypatch.setattr(graph, "_coloured", coloured)
    assert {r.node: r.comp for r in graph.strong_components(edges, small=6).collect()} == want
