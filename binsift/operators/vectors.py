"""Nearest vectors by an index of cells: exact, with most of the store left unread where it has clusters.

The index deals unit vectors to the nearest of some centroids and writes them by cell, with the angle of each to its
centroid. Angles obey the triangle inequality, so a vector at angle t from a centroid that is at angle p from a query is at
least |p - t| from the query: with the least and the greatest t of a cell that bounds all its cosines. A search first
looks into the nearest cell of each query, then into those cells only whose bound reaches the best it has found so far, and
the least cosine asked for. What is left out can't win or tie, so the result is that of comparing all pairs.

Centroids are fitted on a bounded sample (SAMPLE vectors, in the order of a hash of the id); every vector is indexed. They
and the bounds of cells are a table of at most CELLS rows. Queries are a stated set and go to tasks in blocks of known size,
those of the same cells together, so that a block reads few cells; a cell is read by as many tasks as its files need.

Defined results: null vectors, and those without length, are in no cell and find nothing; vectors of another length than
the first centroid's are an error. Of equal cosines the least id wins; an id doesn't find itself. An empty store or no
queries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import saved
from .shipping import ship

#: Vectors that centroids are fitted on, and rounds of it; centroids at most.
SAMPLE, ROUNDS, CELLS = 8192, 8, 256
#: Rows of a cell's vectors to a centroid, at least, that a cell is made for.
PER_CELL = 32
#: Cosine by which bounds are widened: half a unit of the last place that cosines are rounded to, and rounding errors.
SLACK = 2e-6


@dataclass
class Index:
    """rows (store_id, unit, angle), written by cell; of each cell its centroid and the least and greatest angle."""

    rows: DataFrame
    centroids: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    counts: np.ndarray

    def angles(self, q: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(q @ self.centroids.T, -1, 1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Greatest cosine that a vector of each cell can have with each query."""
        p = self.angles(q)
        apart = np.maximum(np.maximum(p - self.greatest, self.least - p), 0)
        return np.where(self.counts > 0, np.cos(np.minimum(apart, np.pi)) + SLACK, -2.0)


@dataclass
class Searched:
    """What a search compared: pairs of a query and a vector, of all there are."""

    pairs: int = 0
    of: int = 0


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN for those without length."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(-1, keepdims=True)) if m.size else m.reshape(0, 0)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by rounds of nearest directions and their mean directions."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        of = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def index(store: DataFrame) -> Index | None:
    """Index of a store (store_id, stored); None if it has no vector."""
    ship(store.sparkSession)
    rows = store.select(F.col("store_id").cast("long").alias("store_id"), F.col("stored").cast("array<double>").alias("stored")).filter("stored IS NOT NULL AND store_id IS NOT NULL AND exists(stored, x -> x <> 0)")
    drawn = rows.select("stored", "store_id").orderBy(F.xxhash64("store_id"), "store_id").limit(SAMPLE).collect()
    if not drawn:
        return None
    sample = units(np.array([r.stored for r in drawn], dtype=np.float64))
    cells = int(np.clip(len(sample) // PER_CELL, 1, CELLS))
    centroids = fitted(sample, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = units(np.stack(b.column("stored").to_numpy(zero_copy_only=False)))
            cos = v @ centroids.T
            cell = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(v)), cell], -1, 1))
            flat = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("store_id"), flat, pa.array(angle), pa.array(cell.astype(np.int32))], ["store_id", "unit", "angle", "cell"])

    # dealt by ranges, so that a large cell is written by many tasks and a task writes few cells
    dealt = rows.mapInArrow(run, "store_id long, unit array<double>, angle double, cell int").repartitionByRange("cell", "store_id")
    table = saved(dealt, by="cell")
    least, greatest, counts = np.full(cells, np.pi), np.zeros(cells), np.zeros(cells, dtype=np.int64)
    for r in table.groupBy("cell").agg(F.min("angle").alias("least"), F.max("angle").alias("greatest"), F.count("*").alias("n")).collect():
        least[r.cell], greatest[r.cell], counts[r.cell] = r["least"], r["greatest"], r.n
    return Index(table, centroids, least, greatest, counts)


def search(queries: DataFrame, at: Index | None, least: float, block: int = 2000, seen: Searched | None = None) -> DataFrame:
    """For each query vector (id, vector) the stored vector of the greatest cosine, itself left out, if it reaches `least`:
    id, store_id, cos (to six places). `seen` is told how many pairs were compared."""
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "id long, store_id long, cos double")
    if at is None:
        return empty
    asked = saved(queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL AND id IS NOT NULL AND exists(vector, x -> x <> 0)"))
    found = None
    for ids, q in _blocks(asked, at, block):
        bounds = at.bounds(q)
        first = np.zeros(bounds.shape, dtype=bool)
        first[np.arange(len(q)), bounds.argmax(axis=1)] = True
        near = saved(_compared(at, ids, q, first, least))
        best = dict(near.groupBy("id").agg(F.max("cos").alias("cos")).collect())  # one row a query of the block
        have = np.array([best.get(i, least) for i in ids.tolist()])
        rest = (bounds >= np.maximum(have, least)[:, None]) & ~first
        found = near if found is None else found.unionByName(near)
        if rest.any():
            found = found.unionByName(_compared(at, ids, q, rest, least))
        if seen is not None:
            seen.pairs += int(((first | rest) * at.counts).sum())
            seen.of += len(q) * int(at.counts.sum())
    if found is None:
        return empty
    best = F.max_by(F.struct("store_id", "cos"), F.struct("cos", -F.col("store_id")))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.store_id", "b.cos")


def _blocks(asked: DataFrame, at: Index, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, at most about `block` at a time, those of the same nearest cells together."""
    centroids = at.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (units(np.stack(b.column("vector").to_numpy(zero_copy_only=False))) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["id", "vector", "cell"])

    placed = saved(asked.mapInArrow(run, "id long, vector array<double>, cell int"))
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    group: list[int] = []
    for cell in [*sorted(counts), None]:
        full = cell is None or group and sum(counts[c] for c in group) + counts[cell] > block
        if full and group:
            mine = placed.filter(F.col("cell").isin(group))
            parts = -(-sum(counts[c] for c in group) // block)
            for k in range(parts):
                rows = sorted((r.id, r.vector) for r in mine.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("id", "vector").collect())
                if rows:
                    yield np.array([i for i, _ in rows], dtype=np.int64), units(np.array([v for _, v in rows], dtype=np.float64))
            group = []
        if cell is not None:
            group.append(cell)


def _compared(at: Index, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, least: float) -> DataFrame:
    """Best of the wanted cells (a row a query) that each task finds: id, store_id, cos."""
    spark = at.rows.sparkSession
    shared = spark.sparkContext.broadcast((ids, q, wanted))
    cells = np.flatnonzero(wanted.any(axis=0)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted = shared.value
        best, of = np.full(len(ids), -2.0), np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            cell = b.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                some, mine = np.flatnonzero(wanted[:, c]), np.flatnonzero(cell == c)
                own = b.column("store_id").to_numpy()[mine]
                v = np.stack(b.column("unit").take(pa.array(mine)).to_numpy(zero_copy_only=False))
                cos = np.floor(q[some] @ v.T * 1e6 + 0.5) / 1e6
                cos[ids[some][:, None] == own[None, :]] = -2.0
                order = np.argsort(own, kind="stable")  # of equal ones the least id
                to = order[cos[:, order].argmax(axis=1)]
                top = cos[np.arange(len(some)), to]
                better = (top > best[some]) | (top == best[some]) & (own[to] < of[some])
                best[some[better]], of[some[better]] = top[better], own[to[better]]
        good = np.flatnonzero(best >= least)
        yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(of[good]), pa.array(best[good])], ["id", "store_id", "cos"])

    return at.rows.filter(F.col("cell").isin(cells)).select("store_id", "unit", "cell").mapInArrow(run, "id long, store_id long, cos double")
