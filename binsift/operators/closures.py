"""Values that spread along edges inside functions, one function at a time over a table that Spark deals and sorts by function.

A task holds the edges of one function; of one beyond `most` edges it lets them go as they stream past and names it instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

#: Kinds of rows found: a value, a cycle that has no best value, a function that is too long.
VALUE, CYCLE, LONG = range(3)
#: Rows after which a task hands on what it has found.
FLUSH = 20_000


def spread(to: dict[str, list[str]], own: dict[str, int], cost: int) -> dict[str, int] | None:
    """The least value of every variable that has one: its own or a source's plus cost. None if there is no least."""
    if cost >= 0:  # a variable taken out first has its least value
        best, heap = dict(own), [(x, v) for v, x in own.items()]
        heapq.heapify(heap)
        while heap:
            x, v = heapq.heappop(heap)
            if x == best[v]:
                for b in to.get(v, ()):
                    if b not in best or x + cost < best[b]:
                        best[b] = x + cost
                        heapq.heappush(heap, (x + cost, b))
        return best
    met, todo = set(own), list(own)  # each after all its sources, of those that a value reaches
    need: dict[str, int] = {}
    while todo:
        for b in to.get(todo.pop(), ()):
            need[b] = need.get(b, 0) + 1
            if b not in met:
                met.add(b)
                todo.append(b)
    best, ready, done = dict(own), [v for v in met if v not in need], 0
    while ready:
        v = ready.pop()
        done += 1
        for b in to.get(v, ()):
            best[b] = min(best.get(b, best[v] + cost), best[v] + cost)
            need[b] -= 1
            if not need[b]:
                ready.append(b)
    return best if done == len(met) else None


def _each(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, dict[str, list[str]], list[tuple[str, int]], bool]]:
    """Each function of a sorted stream with its edges, its own values and whether it is too long."""
    now, to, own, n = None, {}, [], 0
    for batch in batches:
        for fn, src, dst, x in zip(*(batch.column(c).to_pylist() for c in ("fn", "src", "dst", "x"))):
            if fn != now:
                if now is not None:
                    yield now, to, own, n > most
                now, to, own, n = fn, {}, [], 0
            n += 1
            if n > most:
                to, own = {}, []
            elif src is None:
                own.append((dst, x))
            else:
                to.setdefault(src, []).append(dst)
    if now is not None:
        yield now, to, own, n > most


def found(edges: DataFrame, own: DataFrame, least: bool, step: int, most: int) -> DataFrame:
    """fn, var, x, kind: the best values along edges (fn, src, dst) from own ones (fn, var, x), and in rows of other kinds
    functions with a cycle that has none (CYCLE) or with more than `most` edges and values (LONG)."""
    ship(edges.sparkSession)
    values = own.select("fn", F.lit(None).cast("string").alias("src"), F.col("var").alias("dst"), F.col("x").cast("long"))
    rows = edges.select("fn", "src", "dst", F.lit(None).cast("long").alias("x")).unionByName(values)
    schema = pa.schema([("fn", pa.string()), ("var", pa.string()), ("x", pa.int64()), ("kind", pa.int32())])
    sign = 1 if least else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def add(fn: str, got: dict[str | None, int | None], kind: int) -> None:
            out[0].extend([fn] * len(got))
            out[1].extend(got)
            out[2].extend(None if x is None else sign * x for x in got.values())
            out[3].extend([kind] * len(got))

        for fn, to, mine, long in _each(batches, most):
            if long:
                add(fn, {None: None}, LONG)
            elif mine:
                first: dict[str, int] = {}
                for v, x in mine:
                    first[v] = min(first.get(v, sign * x), sign * x)
                got = spread(to, first, sign * step)
                add(fn, {None: None} if got is None else got, CYCLE if got is None else VALUE)
            if len(out[0]) >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                out = ([], [], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    dealt = rows.repartition("fn").sortWithinPartitions("fn")
    return dealt.mapInArrow(run, "fn string, var string, x long, kind int")
