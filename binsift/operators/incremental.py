"""The walk of a changed program: only functions that changed and those above them are done again.

What a function's walk depends on is its own operations, the effects of the functions it calls and takes the address of,
the positions at which callers taint it, and its reach. A digest of each function's operations tells what changed; effects
can only change in changed functions and in those from which one can be reached by calls, so that set, closed upwards over
the calls of before and now, is summarised again with the stored effects of all others. Marks of callers are made again for
the same set and joined with the stored ones; functions whose marked positions differ are walked again too, and the rest
keep their rows. A run over what was stored gives the same tables as a run over everything.

Defined results: functions that are gone lose their rows, and their callers are done again; new ones are changed ones. The
digest doesn't depend on the order of rows, but counts repeated ones. Without a state before, everything is done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import taint
from .graph import distances, saved


@dataclass
class State:
    """Tables that a run leaves for the next one. All but `done`, the functions that this run walked, are of the program
    as a whole; an application stores them (`columns` names them) and gives them back."""

    digests: DataFrame
    edges: DataFrame
    effects: DataFrame
    passed: DataFrame
    external: DataFrame
    walked: DataFrame
    done: DataFrame | None = None

    columns = ("digests", "edges", "effects", "passed", "external", "walked")


def digests(ops: DataFrame, entries: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """fn, digest: of a function's operations, the addresses it takes and its reach, added up over rows."""
    row = F.struct("seq", "op", "callee", "out_var", "args", "sizes")
    parts = ops.select("fn", F.xxhash64(F.to_json(row)).alias("h"))
    if entries is not None:
        parts = parts.unionByName(taint.pointers(ops, entries).select("fn", F.xxhash64(F.lit("target"), "address", "callee").alias("h")))
    if reach is not None:
        parts = parts.unionByName(reach.join(ops.select("fn").distinct(), "fn", "left_semi").select("fn", F.xxhash64(F.lit("reach"), F.col("reach").cast("double")).alias("h")))
    wide = F.col("h").cast("decimal(20,0)")
    return parts.groupBy("fn").agg(F.concat_ws(":", F.sum(wide).cast("string"), F.sum(wide * (F.abs(F.col("h") % 1_000_003) + 1)).cast("string"), F.count("h")).alias("digest"))


def run(ops: DataFrame, before: State | None = None, entries: DataFrame | None = None, reach: DataFrame | None = None) -> State:
    """Effects, marks of callers and walked functions of a program, from those of the version before."""
    ops = saved(ops)
    now = saved(digests(ops, entries, reach))
    edges = taint.calls(ops)
    edges = saved(edges if entries is None else edges.unionByName(taint.pointers(ops, entries).select("fn", "callee")).distinct())
    if before is None:
        effects = saved(taint.summaries(ops, entries))
        passed = saved(taint.passed(ops, effects))
        external = saved(taint.entered(ops, passed.select("fn", "arg").distinct()))
        walked = saved(taint.analyze(ops, effects, external, entries, reach))
        return State(now, edges, effects, passed, external, walked, now.select("fn"))
    changed = now.join(before.digests, ["fn", "digest"], "left_anti").select("fn").unionByName(before.digests.join(now, "fn", "left_anti").select("fn")).distinct()
    both = edges.unionByName(before.edges.select("fn", "callee")).select(F.col("fn").alias("caller"), "callee").distinct()
    dirty = saved(distances(both, changed.select(F.col("fn").alias("node")), backwards=True).select(F.col("node").alias("fn")))
    held = lambda df, by="fn": df.join(dirty.withColumnRenamed("fn", by), by, "left_anti")
    mine = saved(ops.join(dirty, "fn", "left_semi"))
    # summaries gives the effects it was told of back with those it found
    effects = saved(taint.summaries(mine, entries, known=held(before.effects)))
    passed = saved(held(before.passed, "by").select("by", "fn", "arg").unionByName(taint.passed(mine, effects)))
    external = saved(taint.entered(ops, passed.select("fn", "arg").distinct()))
    told = external.filter("arg >= 0").select("fn", "arg")
    other = told.exceptAll(before.external.filter("arg >= 0").select("fn", "arg")).unionByName(before.external.filter("arg >= 0").select("fn", "arg").exceptAll(told))
    again = saved(dirty.unionByName(other.select("fn")).distinct().join(now, "fn", "left_semi").select("fn"))
    kept = before.walked.join(now, "fn", "left_semi").join(again, "fn", "left_anti")
    fresh = taint.analyze(ops.join(again, "fn", "left_semi"), effects, external, entries, reach)
    return State(now, edges, effects, passed, external, saved(kept.select(*fresh.columns).unionByName(fresh)), again)
