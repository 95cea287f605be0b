"""Python code that goes through one function's operations in order, as a stream over a sorted table.

Operations are dealt by function and sorted within partitions by Spark, so a task meets one function after the other, each
in order, however many Arrow batches it spans. What is known of a function (facts: effects of those it calls, names by
address, parameters that callers taint, its reach) are rows of the same table that sort before its operations. A task holds
the operations of one function at a time, as Arrow slices of the batches they came in, and decodes SLICE of them at a time
where a function is long: memory goes with the bytes of one function, not with a batch of functions or a row per function.
Nothing is counted or gathered beforehand; a function beyond `most` operations is let go while it streams past.

Defined results: functions without operations have none; rows of equal function and seq are in the order of their columns;
a null function is a function like others.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

#: Operations decoded at a time of functions that have more, and how many such slices are kept for reading here and there.
SLICE, KEPT = 4096, 8
#: Functions and operations after which a task hands on what it has found.
FLUSH_FUNCTIONS, FLUSH_OPS = 256, 20_000
FIELDS = ("seq", "op", "callee", "out", "args", "sizes")
#: Kinds of rows, in the order they come in.
EFFECT, TARGET, VARIABLE, REACH, OPERATION = range(5)


class Operations(Sequence):
    """Operations of one function, as dicts of FIELDS."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.starts: list[int] = [0]
        self._read: dict[int, list[dict]] = {}  # slices by their first place, the one read last at the end

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)
        self.starts.append(self.starts[-1] + part.num_rows)

    def __len__(self) -> int:
        return self.starts[-1]

    def __iter__(self) -> Iterator[dict]:
        for part in self.parts:
            for lo in range(0, part.num_rows, SLICE):
                yield from _decoded(part.slice(lo, SLICE))

    def __getitem__(self, k: int) -> dict:
        k += len(self) if k < 0 else 0
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = bisect_right(self.starts, k) - 1
        lo = (k - self.starts[i]) // SLICE * SLICE
        first = self.starts[i] + lo
        rows = self._read.pop(first, None)
        if rows is None:
            rows = _decoded(self.parts[i].slice(lo, SLICE))
            if len(self._read) == KEPT:
                del self._read[next(iter(self._read))]
        self._read[first] = rows
        return rows[k - first]

    def short(self) -> Sequence[dict]:
        """All of them in a list if they are few, else themselves."""
        return list(self) if len(self) <= SLICE else self


def _decoded(part: pa.RecordBatch) -> list[dict]:
    return [dict(zip(FIELDS, row)) for row in zip(*(part.column(c).to_pylist() for c in FIELDS))]


@dataclass
class Facts:
    """What is known of a function before its operations are seen."""

    effects: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    targets: dict[int, str] = field(default_factory=dict)
    variables: list[int] = field(default_factory=list)
    reach: float | None = None

    def add(self, part: pa.RecordBatch) -> None:
        for kind, at, name, callee, x in zip(*(part.column(c).to_pylist() for c in ("kind", "seq", "op", "callee", "x"))):
            if kind == EFFECT:
                self.effects.setdefault(callee, []).append((at, name))
            elif kind == TARGET:
                self.targets[at] = callee
            elif kind == VARIABLE:
                self.variables.append(at)
            else:
                self.reach = x


Job = Callable[[str, Sequence[dict], Facts], list[dict]]


def effects_of(edges: DataFrame, effects: DataFrame) -> DataFrame:
    """Facts: effects (fn, arg, effect) of the functions that edges (fn, callee) lead to."""
    met = edges.join(effects.select(F.col("fn").alias("callee"), "arg", "effect"), "callee")
    return _row(met, EFFECT, seq="arg", op="effect", callee="callee")


def targets_of(taken: DataFrame) -> DataFrame:
    """Facts: names by address (fn, address, callee)."""
    return _row(taken, TARGET, seq="address", callee="callee")


def variables_of(external: DataFrame) -> DataFrame:
    """Facts: positions (fn, arg) of parameters that callers taint; negative ones are none."""
    return _row(external.filter("arg >= 0").select("fn", "arg").distinct(), VARIABLE, seq="arg")


def reach_of(reach: DataFrame) -> DataFrame:
    """Facts: how surely input reaches functions (fn, reach)."""
    return _row(reach, REACH, x="reach")


def _row(df: DataFrame, kind: int, **named: str) -> DataFrame:
    at = lambda c, t: (F.col(named[c]) if c in named else F.lit(None)).cast(t).alias(c)
    return df.select("fn", F.lit(kind).alias("kind"), at("seq", "long"), at("op", "string"), at("callee", "string"), at("out", "string"), at("args", "array<string>"), at("sizes", "array<int>"), at("x", "double"))


def one_by_one(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[str, Operations, Facts]]:
    """Each function of a sorted stream of rows with its operations and facts."""
    begun, fn, ops, facts = False, None, Operations(), Facts()
    for b in batches:
        if not b.num_rows:
            continue
        names = np.array([*b.column("fn").to_pylist(), None], dtype=object)[:-1]
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), b.num_rows]
        kinds = b.column("kind").to_numpy()
        for lo, hi in zip(cuts, cuts[1:]):
            if not begun or names[lo] != fn:
                if len(ops) and (most is None or len(ops) <= most):
                    yield fn, ops, facts
                begun, fn, ops, facts = True, names[lo], Operations(), Facts()
            told = int((kinds[lo:hi] != OPERATION).sum())
            if told:
                facts.add(b.slice(lo, told))
            if told < hi - lo:
                ops.add(b.slice(lo + told, hi - lo - told))
                if most is not None and len(ops) > most:
                    ops.parts.clear()  # counted on, not kept
    if len(ops) and (most is None or len(ops) <= most):
        yield fn, ops, facts


def per_function(ops: DataFrame, make: Callable[[], Job], schema: str, arrow: pa.Schema, facts: Sequence[DataFrame] = (), most: int | None = None) -> DataFrame:
    """Rows that a job gives for each function. ops: fn, seq, op, callee, out_var, args, sizes; make is called in each task."""
    ship(ops.sparkSession)
    own = _row(ops, OPERATION, seq="seq", op="op", callee="callee", out="out_var", args="args", sizes="sizes")
    rows = reduce(DataFrame.unionByName, facts, own)
    ordered = rows.repartition("fn").sortWithinPartitions("fn", "kind", *[F.col(c).asc_nulls_first() for c in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, found, functions, walked = make(), [], 0, 0
        for fn, held, told in one_by_one(batches, most):
            found += job(fn, held.short(), told)
            functions, walked = functions + 1, walked + len(held)
            if functions >= FLUSH_FUNCTIONS or walked >= FLUSH_OPS:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)
                found, functions, walked = [], 0, 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return ordered.mapInArrow(run, schema)
