"""Connected components of an edge table, in rounds of joins and aggregations over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, saved

#: Edges that are few enough for one task: rounds of jobs over them cost more than they do.
FEW = 1 << 15


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node of its component, for every node of edges (u, v).

    A round hooks each node to that of its neighbours and itself which comes first in an order drawn anew by a hash, twice
    over, and contracts the graph to the nodes hooked to. About half of the nodes or more go in a round, whatever the
    shape (a chain of n nodes takes some log2 n rounds), and with them the work. The rounds' maps are then composed, the
    smallest first. Once at most FEW edges are left, one task contracts them. Nothing is collected but a count. A self edge gives a component of one node; null ends
    are left out; repeated edges count once; no edges give an empty table.
    """
    one = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v")
    every = saved(one.select(F.col("u").alias("node")).unionByName(one.select(F.col("v").alias("node"))).distinct())
    now = saved(one.filter("u != v").distinct())
    maps: list[DataFrame] = []
    while n := now.limit(FEW + 1).count():
        if n <= FEW:
            maps.append(saved(_contracted(now)))
            break
        drawn = len(maps)

        def first(c: str, drawn: int = drawn) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(drawn)).alias("p"), F.col(c).alias("to"))

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = saved(both.groupBy("u").agg(F.min(first("v")).alias("best")).select("u", F.least("best", first("u"))["to"].alias("to")))
        again = hooked.select(F.col("u").alias("to"), F.col("to").alias("then"))
        step = saved(hooked.join(again, "to").select("u", F.col("then").alias("to")))
        maps.append(step)
        ends = step.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        now = saved(now.join(step, "u").join(ends, "v").filter("to != to_v").select(F.least("to", "to_v").alias("u"), F.greatest("to", "to_v").alias("v")).distinct())
    if not maps:
        return every.select("node", F.col("node").alias("comp"))
    found = maps[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = saved(step.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root")))
    least = found.groupBy("root").agg(F.min("node").alias("comp"))
    named = found.join(least, "root").select("node", "comp")
    return saved(every.join(named, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))


def _contracted(edges: DataFrame) -> DataFrame:
    """u and `to`, one node of its component, for every node of few edges (u, v)."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        root: dict = {}

        def top(x: object) -> object:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        like = None
        for b in batches:
            like = b.schema.field("u").type
            for ends in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                u, v = (tuple(x.values()) if isinstance(x, dict) else x for x in ends)
                for name, x in zip((u, v), ends):
                    if root.setdefault(name, name) == name:
                        own[name] = x
                root[top(u)] = top(v)
        if like is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in root], like), pa.array([own[top(x)] for x in root], like)], ["u", "to"])

    return arrow_map(edges.coalesce(1), run, f"u {kind}, to {kind}")
