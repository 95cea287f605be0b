"""Call-graph operators: rounds of joins and aggregations over edges (caller, callee).

Every round writes what is new once, as a table in the shared folder; what was known before isn't written again. The number of rounds
is a constant of the operator or, for closures and levels, lasts until no row is new; nothing is collected but counts.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import closures

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in local mode may leave it unset: it has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        import tempfile

        named = f"file://{tempfile.mkdtemp(prefix='binsift-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """df without its lineage: written once to the shared folder, in a folder for each value of a column if named, and read
    back. The shuffle files of the query that made it go when it is written."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/binsift-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that release() deletes."""
    path = f"{_shared(spark)}/binsift-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def grows(df: DataFrame) -> DataFrame:
    """df to be joined by sorting. For tables of a row per function or node, of which many joins would each send a whole copy
    through the driver while it is under the size for a broadcast."""
    return df.hint("merge")


class Grown:
    """A table that grows by a part a round. Parts stay as they were written; of many, one is made now and then."""

    def __init__(self, first: DataFrame, most: int = 16):
        self.parts, self.most = [first], most

    def add(self, part: DataFrame) -> None:
        if len(self.parts) == self.most:
            self.parts = [saved(self.all())]
        self.parts.append(part)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


@atexit.register
def release() -> None:
    """Delete the tables that operators wrote to the shared folder. Call it when results are written: DataFrames made
    before can't be read after. At the latest it happens when the interpreter ends."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before the interpreter  # noqa: BLE001
            pass


def call_graph(call_sites: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct edges of recorded call sites and CALL targets; addresses are resolved to function names or dropped.

    call_sites (caller, callee), calls (caller, target), functions (fn, entry_addr).
    """
    from ..functions.names import address

    at = functions.select(F.col("fn").alias("_fn"), address(F.col("entry_addr")).alias("_addr"))
    named = calls.withColumn("_addr", F.when(F.col("target").startswith("0x") | F.col("target").startswith("ram("), address(F.col("target"))))
    found = named.join(at, "_addr", "left").select("caller", F.coalesce("_fn", F.when(F.col("_addr").isNull(), F.col("target"))).alias("callee"))
    return call_sites.select("caller", "callee").unionByName(found).filter("callee IS NOT NULL").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("node")).union(edges.select("callee")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out of distinct edges."""
    out = edges.groupBy(F.col("caller").alias("node")).agg(F.count_distinct("callee").alias("fan_out"))
    into = edges.groupBy(F.col("callee").alias("node")).agg(F.count_distinct("caller").alias("fan_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def distances(edges: DataFrame, seeds: DataFrame, hops: int | None = None, backwards: bool = False) -> DataFrame:
    """node and its distance (0 for seeds) along edges, or against them, up to `hops`, or as far as they lead."""
    step = edges.select(F.col("callee").alias("node"), F.col("caller").alias("to")) if backwards else edges.select(F.col("caller").alias("node"), F.col("callee").alias("to"))
    step = saved(step.distinct())
    front = saved(seeds.select("node", F.lit(0).alias("dist")).distinct())
    seen = Grown(front)
    for d in count(1) if hops is None else range(1, hops + 1):
        reached = front.join(step, "node").select(F.col("to").alias("node")).distinct().join(grows(seen.all()), "node", "left_anti")
        front = saved(reached.withColumn("dist", F.lit(d)))
        if front.limit(1).count() == 0:
            break
        seen.add(front)
    return seen.all()


def source_distance(edges: DataFrame, is_source: Column, hops: int = 4) -> DataFrame:
    """Hops from each node down to a callee that is a source; hops + 1 beyond."""
    seeds = nodes(edges).filter(is_source).select("node")
    near = distances(edges, seeds, hops, backwards=True)
    return nodes(edges).join(grows(near), "node", "left").select("node", F.coalesce("dist", F.lit(hops + 1)).alias("dist"))


def reachable(edges: DataFrame, is_seed: Column, is_write: Column, hops: int | None = None, least_share: float = 0.05) -> DataFrame:
    """Nodes that data from seeds reaches: seeds and all their callers, and theirs (up to `hops`, if given). If that is under
    `least_share` of the nodes, all nodes but the write-only ones instead."""
    every = nodes(edges)
    near = distances(edges, every.filter(is_seed).select("node"), hops, backwards=True).select("node")
    total, found = every.count(), near.count()
    return near if found >= least_share * total else every.filter(~is_write).select("node")


def reaches_within(edges: DataFrame, is_target: Column, hops: int) -> DataFrame:
    """Nodes with a node that is a target among their callees within `hops` edges."""
    targets = nodes(edges).filter(is_target).select("node")
    first = edges.join(targets.withColumnRenamed("node", "callee"), "callee", "left_semi").select(F.col("caller").alias("node")).distinct()
    return distances(edges, first, hops - 1, backwards=True).select("node")


def page_rank(edges: DataFrame, personal: DataFrame | None, rounds: int = 25, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """node, rank: a node gets damping times what its callees pass on (each its rank over its number of callers) and the
    rest from `personal` (node, weight). No mass is spread from nodes without callees; at the end divided by the greatest
    rank and rounded to four places. Without personal weights: fan-in over the greatest fan-in."""
    every = nodes(edges)
    if personal is None:
        d = degrees(edges)
        return d.join(d.agg(F.max("fan_in").alias("most"))).select("node", F.round(F.col("fan_in") / F.greatest("most", F.lit(1)), 4).alias("rank"))
    n = every.count()
    callers = edges.groupBy("callee").agg(F.count("caller").alias("callers"))
    weighted = saved(edges.join(callers, "callee").select("caller", F.col("callee").alias("node"), (1.0 / F.col("callers")).alias("part")))
    base = saved(every.join(personal, "node", "left").select("node", ((1 - damping) * F.coalesce("weight", F.lit(0.0))).alias("base")))
    # Only what nodes with callers have is passed on; the others get theirs in the last round.
    called = weighted.select("node").distinct()
    inner, passing = saved(weighted.join(called.withColumnRenamed("node", "caller"), "caller", "left_semi")), saved(base.join(called, "node", "left_semi"))
    rank = passing.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        along, of = (weighted, base) if i == rounds - 1 else (inner, passing)
        sent = rank.join(along, "node").groupBy(F.col("caller").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        rank = of.join(grows(sent), "node", "left").select("node", (F.coalesce("got", F.lit(0.0)) * damping + F.col("base")).alias("rank"))
        if i % cut_every == cut_every - 1:
            rank = saved(rank)
    if not rounds:
        rank = base.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    top = rank.agg(F.max("rank").alias("top"))
    return rank.join(F.broadcast(top)).select("node", F.round(F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(F.lit(0.0)), 4).alias("rank"))


def propagate_scores(scores: DataFrame, edges: DataFrame, rounds: int = 2, down: float = 0.15, up: float = 0.10, big: int = 500, cap: float = 2.0) -> DataFrame:
    """node, score: each round adds `down` times the callees' scores (at most `cap` for functions of over `big`
    operations) and `up` times the callers', all of the round before; rounded to four places. scores: node, score, ops."""
    now = scores
    for _ in range(rounds):
        s = now.select("node", "score")
        callee = edges.join(s.withColumnRenamed("node", "callee"), "callee").groupBy(F.col("caller").alias("node")).agg(F.sum("score").alias("below"))
        caller = edges.join(s.withColumnRenamed("node", "caller"), "caller").groupBy(F.col("callee").alias("node")).agg(F.sum("score").alias("above"))
        limit = F.when(F.col("ops") > big, cap).otherwise(999.0)
        total = F.col("score") + F.least(F.coalesce("below", F.lit(0.0)) * down, limit) + F.coalesce("above", F.lit(0.0)) * up
        now = saved(now.join(grows(callee), "node", "left").join(grows(caller), "node", "left").select("node", F.round(F.round(total, 9), 4).alias("score"), "ops"))
    return now.select("node", "score")


def levels(edges: DataFrame, small: int = 100_000, fill: int = 64) -> DataFrame:
    """node, level: callees before callers (0 for nodes that call nothing), null for members of cycles and their callers.

    A level is the greatest length of a path down, so nodes that don't touch each other are taken out at once: an edge of
    added length leads from each caller of such a node to each of its callees, the longest of equal ends is kept, and the
    node gets its level from its callees' at the end. Those that have fewer edges than all their neighbours go, so many
    functions around few that most of them call take one step, and a chain of n some log n. That goes on while edges are
    more than `small` and a step makes at most `fill` rows an edge and leaves fewer edges. What is left is peeled: on the
    driver if that is at most `small` edges, else in rounds of joins, with the same result.
    """
    edges = saved(edges.select("caller", "callee").distinct().withColumn("w", F.lit(1)))
    spark, n = edges.sparkSession, edges.count()
    if n <= small:
        return spark.createDataFrame(list(_peeled(edges.collect(), {}).items()), "node string, level int")
    own = saved(nodes(edges).withColumn("x", F.lit(0)))
    out: list[tuple[DataFrame, DataFrame]] = []
    while n > small:
        gone = saved(_apart(edges))
        gone_as = lambda end: gone.select(F.col("node").alias(end))  # noqa: B023, E731
        rows = gone.agg(F.sum(F.col("into") * F.col("out"))).first()[0]
        if rows is None or rows > fill * n:  # there is none, or they have too many paths through them
            break
        down, up = edges.join(gone_as("caller"), "caller", "left_semi"), edges.join(gone_as("callee"), "callee", "left_semi")
        stay = edges.join(gone_as("caller"), "caller", "left_anti").join(gone_as("callee"), "callee", "left_anti")
        through = up.select("caller", F.col("callee").alias("_at"), "w").join(down.select(F.col("caller").alias("_at"), "callee", F.col("w").alias("_w")), "_at")
        made = saved(stay.unionByName(through.select("caller", "callee", (F.col("w") + F.col("_w")).alias("w"))).groupBy("caller", "callee").agg(F.max("w").alias("w")))
        if (m := made.count()) >= n:
            break
        ends = up.join(own.withColumnRenamed("node", "callee"), "callee").select(F.col("caller").alias("node"), (F.col("w") + F.col("x")).alias("x"))
        went = own.join(gone.select("node"), "node", "left_semi")
        out.append((went, saved(down)))
        own = saved(own.join(gone.select("node"), "node", "left_anti").unionByName(ends).groupBy("node").agg(F.max("x").alias("x")))
        edges, n = made, m
    if n <= small:
        peeled = _peeled(edges.collect(), dict(own.join(nodes(edges), "node", "left_semi").collect()))
        peeled = spark.createDataFrame(list(peeled.items()), "node string, level int")
        found = saved(peeled.unionByName(own.select("node", F.col("x").alias("level")).join(nodes(edges), "node", "left_anti")))
    else:
        found = _peeled_in_rounds(edges, own)
    for went, down in reversed(out):
        of = down.join(found.select(F.col("node").alias("callee"), "level"), "callee").groupBy(F.col("caller").alias("node"))
        of = of.agg(F.max(F.col("w") + F.col("level")).alias("most"), F.bool_or(F.col("level").isNull()).alias("no_end"))
        level = F.when(~F.coalesce("no_end", F.lit(False)), F.greatest("x", "most"))
        found = saved(found.unionByName(went.join(of, "node", "left").select("node", level.alias("level"))))
    return found


def _apart(edges: DataFrame) -> DataFrame:
    """node, into, out (numbers of edges): nodes of which none touches another, each with fewer edges than its neighbours, or
    as many and a lesser hash."""
    both = edges.select(F.col("caller").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")).unionByName(edges.select(F.col("callee").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")))
    degree = saved(both.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")))
    rank = degree.select("node", F.struct(F.col("into") + F.col("out"), F.xxhash64("node"), "node").alias("rank"))
    of = lambda end: rank.select(F.col("node").alias(end), F.col("rank").alias(f"{end}_rank"))
    pairs = edges.select("caller", "callee").join(of("caller"), "caller").join(of("callee"), "callee")
    loses = pairs.select(F.when(F.col("caller_rank") >= F.col("callee_rank"), F.col("caller")).otherwise(F.col("callee")).alias("node"))
    return degree.join(loses.distinct(), "node", "left_anti")


def _peeled_in_rounds(edges: DataFrame, own: DataFrame) -> DataFrame:
    """node, level of edges with lengths (w) and what nodes have at least (own: node, x). A round takes the edges to the
    nodes that were done in the one before, and what these bring; nodes that wait for no other edge are done."""
    last = saved(own.join(edges.select(F.col("caller").alias("node")), "node", "left_anti").select("node", F.col("x").alias("level")))
    done, brought, left = Grown(last), Grown(own), edges
    while last.limit(1).count():
        met = left.join(last.select(F.col("node").alias("callee"), "level"), "callee")
        got = saved(met.groupBy(F.col("caller").alias("node")).agg(F.max(F.col("w") + F.col("level")).alias("x")))
        brought.add(got)
        left = saved(left.join(last.select(F.col("node").alias("callee")), "callee", "left_anti"))
        ready = got.select("node").join(left.select(F.col("caller").alias("node")), "node", "left_anti")
        last = saved(brought.all().join(ready, "node", "left_semi").groupBy("node").agg(F.max("x").alias("level")))
        done.add(last)
    return own.select("node").join(done.all(), "node", "left")


def _peeled(edges: list[tuple[str, str, int]], own: dict[str, int]) -> dict[str, int | None]:
    """Level of each node, callees first; edges have lengths, nodes at least what is their own."""
    callers: dict[str, list[tuple[str, int]]] = {}
    need: dict[str, int] = {}
    for caller, callee, w in edges:
        callers.setdefault(callee, []).append((caller, w))
        need[caller] = need.get(caller, 0) + 1
        need.setdefault(callee, 0)
    most = {n: own.get(n, 0) for n in need}
    out: dict[str, int | None] = dict.fromkeys(need)
    front = [n for n, c in need.items() if c == 0]
    while front:
        n = front.pop()
        out[n] = most[n]
        for c, w in callers.get(n, ()):
            most[c] = max(most[c], most[n] + w)
            need[c] -= 1
            if need[c] == 0:
                front.append(c)
    return out


def strong_components(edges: DataFrame, small: int = 100_000) -> DataFrame:
    """node, comp: the strongly connected component of each node of edges (caller, callee), named by its greatest node.

    By colouring with trimming. Nodes without an edge in or out among those left are components of their own and go first.
    Then the greatest name flows along edges until each node has that of the greatest node it can be reached from; going
    back from that node along edges between nodes of its colour gives its component. Those go, and the rest is done again.
    Rounds read what is left and write what changed. What is left of at most `small` edges, counted first and when nodes have
    gone, is done on the driver instead, with the same result. Self edges and repeated ones change nothing.
    """
    edges = saved(edges.select("caller", "callee").distinct())
    some = edges.limit(small + 1).collect()
    if len(some) <= small:
        return edges.sparkSession.createDataFrame(list(_strong([(r.caller, r.callee) for r in some]).items()), "node string, comp string")
    every = saved(nodes(edges))
    left, size = _trimmed(edges.filter("caller != callee"))
    found: list[DataFrame] = []
    while size:
        if size <= small:
            rest = list(_strong([(r.caller, r.callee) for r in left.collect()]).items())
            found.append(edges.sparkSession.createDataFrame(rest, "node string, comp string"))
            break
        colour = _coloured(left)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        alike = saved(left.join(of("caller"), "caller").join(of("callee"), "callee").filter("caller_colour = callee_colour").select("caller", "callee"))
        roots = saved(colour.filter("node = colour").select("node"))
        mine = saved(distances(alike, roots, backwards=True).select("node").join(colour, "node").select("node", F.col("colour").alias("comp")))
        found.append(mine)
        gone = mine.select("node")
        left, size = _trimmed(left.join(gone.withColumnRenamed("node", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("node", "callee"), "callee", "left_anti").select("caller", "callee"))
    if not found:
        return every.select("node", F.col("node").alias("comp"))
    return every.join(reduce(DataFrame.unionByName, found), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that have one in and one out, until there is no other, and their number."""
    edges = saved(edges)
    n = edges.count()
    while n:
        both = edges.select(F.col("caller").alias("node")).distinct().join(edges.select(F.col("callee").alias("node")).distinct(), "node", "left_semi")
        kept = saved(edges.join(both.withColumnRenamed("node", "caller"), "caller", "left_semi").join(both.withColumnRenamed("node", "callee"), "callee", "left_semi").select("caller", "callee"))
        m = kept.count()
        edges = kept
        if m == n:
            break
        n = m
    return edges, n


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node that each can be reached from, itself included."""
    front = saved(nodes(edges).withColumn("colour", F.col("node")))
    best = Grown(front)
    while True:
        sent = front.withColumnRenamed("node", "caller").join(edges, "caller").groupBy(F.col("callee").alias("node")).agg(F.max("colour").alias("colour"))
        known = best.all().groupBy("node").agg(F.max("colour").alias("_known"))
        front = saved(sent.join(known, "node").filter("colour > _known").drop("_known"))
        if front.limit(1).count() == 0:
            return saved(best.all().groupBy("node").agg(F.max("colour").alias("colour")))
        best.add(front)


def _strong(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Greatest node of each node's component: depth first, with the nodes of open components on a stack."""
    to: dict[str, list[str]] = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
        to.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    out: dict[str, str] = {}
    open_: list[str] = []
    for start in to:
        if start in number:
            continue
        work = [(start, iter(to[start]))]
        number[start] = low[start] = len(number)
        open_.append(start)
        while work:
            node, rest = work[-1]
            nxt = next((b for b in rest if b not in out), None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    k = open_.index(node) if open_[-1] != node else len(open_) - 1
                    mine, open_[k:] = open_[k:], []
                    out.update(dict.fromkeys(mine, max(mine)))
            elif nxt in number:
                low[node] = min(low[node], number[nxt])
            else:
                number[nxt] = low[nxt] = len(number)
                open_.append(nxt)
                work.append((nxt, iter(to[nxt])))
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, scores: DataFrame, least_callee: float, hops: int, most: int) -> DataFrame:
    """Nodes around seeds: callers up to `hops` away, and callees of those visited whose score reaches `least_callee`
    (not followed further); at most `most`, in order of hop, then score, then name: node, hop."""
    up = distances(edges, seeds, hops, backwards=True)
    inside = up.filter(F.col("dist") < hops)
    down = edges.join(inside.select(F.col("node").alias("caller"), (F.col("dist") + 1).alias("hop")), "caller").join(scores.select(F.col("node").alias("callee"), "score"), "callee").filter(F.col("score") >= least_callee)
    both = up.filter("dist > 0").select("node", F.col("dist").alias("hop")).unionByName(down.select(F.col("callee").alias("node"), "hop")).groupBy("node").agg(F.min("hop").alias("hop"))
    fresh = both.join(seeds.select("node"), "node", "left_anti").join(scores, "node", "left")
    return fresh.orderBy("hop", F.desc_nulls_last("score"), "node").limit(most).select("node", "hop")


def neighbours(spark: SparkSession, edges: DataFrame, start: list[str], hops: int = 2) -> DataFrame:
    """Nodes within `hops` edges, either way, of named functions."""
    both = edges.unionByName(edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
    return distances(both, spark.createDataFrame([(n,) for n in start], "node string"), hops)


def tainted(flow: DataFrame, seeds: DataFrame) -> DataFrame:
    """Variables that taint reaches inside functions: closure of flow (fn, src, dst) from seeds (fn, var)."""
    return settled(flow, seeds.select("fn", "var", F.lit(0).alias("x"))).select("fn", "var")


def settled(edges: DataFrame, own: DataFrame, least: bool = True, step: int = 0, hops: int = 4, most: int = 200_000) -> DataFrame:
    """fn, var, x of every variable that has a value of its own (own: fn, var, x) or gets one along edges (fn, src, dst): the
    least, or the greatest, of its own and of what its sources have plus `step`. x is a whole number.

    Edges are dealt by function and each function is settled where it is, in one pass over the table. Functions of more
    than `most` edges and values go in rounds over all of them instead, with the same result.

    A cycle is fine where a step costs nothing. Where it adds (`step` of 1, the greatest), a cycle that a value reaches has
    no greatest, which is an error. Edges with a null end lead nowhere.
    """
    edges = edges.filter("fn IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("fn", "src", "dst")
    edges = edges if step else edges.filter("src != dst")
    own, kind = own.filter("x IS NOT NULL").select("fn", "var", "x"), own.schema["x"].dataType
    nameless, own = own.filter("fn IS NULL OR var IS NULL"), own.filter("fn IS NOT NULL AND var IS NOT NULL")  # no edge leads from these
    got = saved(closures.found(edges, own, least, step, most))
    others = {r.kind for r in got.filter(F.col("kind") != closures.VALUE).select("kind").distinct().collect()}
    if closures.CYCLE in others:
        raise ValueError("flow has a cycle within a function")
    values = got.filter(F.col("kind") == closures.VALUE).select("fn", "var", F.col("x").cast(kind).alias("x"))
    values = values.unionByName(nameless.groupBy("fn", "var").agg((F.min if least else F.max)("x").alias("x")))
    if closures.LONG not in others:
        return values
    long = got.filter(F.col("kind") == closures.LONG).select("fn")
    return values.unionByName(_settled_in_rounds(edges.join(long, "fn", "left_semi"), own.join(long, "fn", "left_semi"), least, step, hops))


def _settled_in_rounds(edges: DataFrame, own: DataFrame, least: bool, step: int, hops: int) -> DataFrame:
    """Values of functions of any length.

    Where most variables have one source, chains of them are contracted by pointer doubling: each variable holds how far
    back it points (`to`), the sum of steps on the way (w) and the best value met there (acc); a round joins the table with
    itself and doubles the distance, so a chain of n takes log2 n rounds. What is left are variables of several sources,
    with edges between the ends of chains; if again most have one source they are contracted too. The rest goes in rounds
    from newly reached or improved variables, `hops` edges a round, and at last chains get their values from their ends.
    """
    better = F.least if least else F.greatest  # of two, nulls left out
    best = F.min if least else F.max
    edges = saved(edges.select("fn", "src", "dst", F.lit(step).alias("w")).distinct())
    own = saved(own.groupBy("fn", "var").agg(best("x").alias("x")))
    chains: list[DataFrame] = []
    while True:
        into = saved(edges.groupBy("fn", F.col("dst").alias("var")).agg(F.count("*").alias("n"), F.first("src").alias("to"), F.first("w").alias("w")))
        single = into.filter("n = 1")
        n = single.count()
        if n == 0 or 2 * n < into.count():
            break
        chain = _doubled(single.join(own, ["fn", "var"], "left").select("fn", "var", "to", "w", F.col("x").alias("acc")), n, better, step)
        chains.append(chain)
        back = chain.select("fn", F.col("var").alias("src"), "to", F.col("w").alias("_w"), "acc", F.lit(True).alias("_in"))
        rest = saved(edges.join(chain.select("fn", F.col("var").alias("dst")), ["fn", "dst"], "left_anti").join(back, ["fn", "src"], "left"))
        gained = rest.filter("acc IS NOT NULL").select("fn", F.col("dst").alias("var"), (F.col("acc") + F.col("w")).alias("x"))
        kept = own.join(chain.select("fn", "var"), ["fn", "var"], "left_anti").select("fn", "var", "x")
        own = saved(kept.unionByName(gained).groupBy("fn", "var").agg(best("x").alias("x")))
        ends = rest.filter("_in IS NULL OR to IS NOT NULL").select("fn", F.coalesce("to", "src").alias("src"), "dst", (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        ends = ends if step else ends.filter("src != dst")
        edges = saved(ends.groupBy("fn", "src", "dst").agg(best("w").alias("w")))
    values = _relaxed(edges, own, best, least, hops)
    for chain in reversed(chains):
        ends = values.select("fn", F.col("var").alias("to"), F.col("x").alias("_x"))
        x = better(F.col("acc"), F.col("_x") + F.col("w"))
        values = saved(values.unionByName(chain.join(ends, ["fn", "to"], "left").select("fn", "var", x.alias("x")).filter("x IS NOT NULL")))
    return values


def _doubled(chain: DataFrame, n: int, better: Callable[..., Column], step: int) -> DataFrame:
    """chain (fn, var, to, w, acc) with `to` at the first variable back that isn't of the chain itself; null where there is
    none, on a cycle and behind one, once the cycle has been gone around."""
    chain = saved(chain)
    for _ in range(n.bit_length() + 1):
        back = chain.select("fn", F.col("var").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("acc").alias("_acc"))
        acc = better(F.col("acc"), F.col("_acc") + F.col("w"))
        longer = chain.select("fn", "var", "to", "w", "acc").join(back, ["fn", "to"], "left")
        chain = saved(longer.select("fn", "var", F.coalesce("_to", "to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), acc.alias("acc"), F.col("_to").isNotNull().alias("on")))
        if chain.filter("on").limit(1).count() == 0:
            return chain
    # what is left points at a variable on its cycle, whose acc is that of the whole cycle
    valued = chain.filter("acc IS NOT NULL").select("fn", F.col("var").alias("to"))
    if step and chain.filter("on").join(valued, ["fn", "to"], "left_semi").limit(1).count():
        raise ValueError("flow has a cycle within a function")
    return chain.withColumn("to", F.when(~F.col("on"), F.col("to")))


def _relaxed(edges: DataFrame, own: DataFrame, best: Callable[[str], Column], least: bool, hops: int) -> DataFrame:
    """Values after rounds from what was new or better in the round before."""
    most = edges.groupBy("fn").agg(F.count_distinct("dst").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    seen, front = Grown(own), own
    # a value takes at most one step to each variable of its function, unless it goes around a cycle that makes it better
    for _ in range(most // hops + 2):
        last, reached = front, None
        for _ in range(hops):
            last = last.select("fn", F.col("var").alias("src"), "x").join(edges, ["fn", "src"]).groupBy("fn", F.col("dst").alias("var")).agg(best(F.col("x") + F.col("w")).alias("x"))
            reached = last if reached is None else reached.unionByName(last)
        known = seen.all().groupBy("fn", "var").agg(best("x").alias("_known"))
        new = reached.groupBy("fn", "var").agg(best("x").alias("x")).join(known, ["fn", "var"], "left")
        front = saved(new.filter("_known IS NULL OR x < _known" if least else "_known IS NULL OR x > _known").select("fn", "var", "x"))
        if front.limit(1).count() == 0:
            return saved(seen.all().groupBy("fn", "var").agg(best("x").alias("x"))) if len(seen.parts) > 1 else own
        seen.add(front)
    raise ValueError("flow has a cycle within a function")


def backward_slice(flow: DataFrame, targets: DataFrame, depth: int = 20) -> DataFrame:
    """Variables that a target variable (fn, target) depends on, with the least number of steps: fn, target, var, depth."""
    flow = saved(flow)
    front = saved(targets.select("fn", "target", F.col("target").alias("var"), F.lit(0).alias("depth")).distinct())
    seen = Grown(front)
    for d in range(1, depth + 1):
        back = front.select("fn", "target", "var").join(flow.select("fn", F.col("dst").alias("var"), "src"), ["fn", "var"]).select("fn", "target", F.col("src").alias("var")).distinct()
        front = saved(back.join(seen.all(), ["fn", "target", "var"], "left_anti").withColumn("depth", F.lit(d)))
        if front.limit(1).count() == 0:
            break
        seen.add(front)
    return seen.all()


def aliases(moves: DataFrame, params: DataFrame) -> DataFrame:
    """Parameter that each variable is an alias of, through moves (fn, src, dst): fn, var, position; of several the
    parameter of the least position."""
    return settled(moves, params.select("fn", "var", F.col("position").alias("x"))).withColumnRenamed("x", "position")


def longest_hops(flow: DataFrame, seeds: DataFrame) -> DataFrame:
    """Longest distance of each tainted variable from a seed along flow, which is acyclic within a function: fn, var, hops.
    A cycle that taint reaches, for which no distance is the longest, is an error."""
    return settled(flow, seeds.select("fn", "var", F.lit(0).alias("x")), least=False, step=1).select("fn", "var", F.col("x").cast("int").alias("hops"))


def external_functions(edges: DataFrame, local: DataFrame, rounds: int = 10) -> DataFrame:
    """Functions that external taint enters: the local ones, and upwards every caller that passes a variable to one of
    them (edges: caller, callee), up to `rounds`: node, dist."""
    return distances(edges, local, rounds, backwards=True)
