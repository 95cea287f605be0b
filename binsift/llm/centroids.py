"""Centroid clustering of integer vectors, exact, with distances screened by the norms of segments.

A component x becomes floor(scale * x). A vector is cut into SEGMENTS runs of components, and the norms of the runs are
its compressed form, made once. By Cauchy and Schwarz the squared distance of x and c is at least
sum over runs of (|x_run| - |c_run|)**2, so the norms alone give lower bounds for all centroids. The centroid of the least
bound gets its exact integer distance first; of the others, only those whose bound doesn't exceed the best distance so far.
Bounds are lowered by more than their rounding error, so no centroid that could win or tie is left out.

A round reads the written table of vectors once; each task adds up its vectors by cluster, and one row a task and cluster
meets in an aggregation whose `clusters` rows come to the driver. Centroids are sent with the tasks: `clusters` times
`size` numbers, whatever the number of vectors.

Defined results: a null array, one of another length, or one with a null, NaN or infinite component is left out. Rows that
repeat an id, null or not, are vectors of their own; a null id comes last in the choice of the first centroids, equal ids
go by their components. With fewer vectors than `clusters` there are fewer centroids; an empty table gives no rows.
A component beyond LARGEST after scaling is an error, for sums of squares would not be exact. Only the three columns named
are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, saved

#: Runs of components whose norms are kept.
SEGMENTS = 8
#: Largest size of a scaled component: 64 squares of twice as much stay below 2**63.
LARGEST = 1 << 27
#: Share of the squared norms by which a bound is lowered; its rounding error is below a thousandth of that.
SLACK = 1e-12


def norms(v: np.ndarray) -> np.ndarray:
    """Norms of the SEGMENTS runs of each row of integers."""
    return np.stack([np.sqrt((part * part).sum(axis=1).astype(np.float64)) for part in np.array_split(v, SEGMENTS, axis=1)], axis=1)


@dataclass
class Screen:
    """Nearest centroids, and how many exact distances they took."""

    centroids: np.ndarray
    exact: int = 0

    def __post_init__(self) -> None:
        self.norms = norms(self.centroids)

    def nearest(self, v: np.ndarray, of_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector (of several, the smallest) and the squared distance."""
        bound = ((of_v[:, None, :] - self.norms[None, :, :]) ** 2).sum(axis=2)
        bound -= SLACK * ((of_v**2).sum(axis=1)[:, None] + (self.norms**2).sum(axis=1)[None, :])
        first = bound.argmin(axis=1)
        best = self._distances(v, self.centroids[first])
        cluster = first.copy()
        for k in range(len(self.centroids)):
            open_ = np.flatnonzero((bound[:, k] <= best) & (first != k))
            d = self._distances(v[open_], self.centroids[k])
            won = (d < best[open_]) | ((d == best[open_]) & (k < cluster[open_]))
            best[open_[won]], cluster[open_[won]] = d[won], k
        return cluster, best

    def _distances(self, v: np.ndarray, c: np.ndarray) -> np.ndarray:
        self.exact += len(v)
        return ((v - c) ** 2).sum(axis=1)


def scaled(df: DataFrame, size: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, components (integers) and norms of the vectors kept."""
    e = F.col(embedding)
    whole = (F.size(e) == size) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.filter(whole).select(F.col(vec_id).alias("vec_id"), F.transform(e, lambda x: x.cast("double")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.floor(scale * rows_of(b.column("x"), size))
            if v.size and np.abs(v).max() > LARGEST:
                raise ValueError(f"a component of a vector is beyond {LARGEST} after scaling by {scale}")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), arrays_of(v.astype(np.int32)), arrays_of(norms(v.astype(np.int64)))], ["vec_id", "components", "norms"])

    return arrow_map(kept, run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, components array<int>, norms array<double>")


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def arrays_of(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel()))


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose ids, behind the seed and a colon, have the smallest SHA-256."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(drawn.alias("h"), "components").orderBy(F.asc_nulls_last("h"), "components").limit(clusters).collect()
    return np.array([r.components for r in rows], dtype=np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of the vectors nearest to each centroid; a centroid without vectors stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, count, total = Screen(centroids), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            v = rows_of(b.column("components"), size).astype(np.int64)
            cluster, _ = screen.nearest(v, rows_of(b.column("norms"), SEGMENTS))
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += v[cluster == c].sum(axis=0)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), arrays_of(total[met])], ["cluster", "n", "total"])

    parts = arrow_map(vectors.select("components", "norms"), run, "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
    new = centroids.copy()
    for r in sums.collect():
        new[r.cluster] = [t // r.n for t in r.total]
    return new


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for b in batches:
            cluster, d = screen.nearest(rows_of(b.column("components"), size).astype(np.int64), rows_of(b.column("norms"), SEGMENTS))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return arrow_map(vectors, run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def fit(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: str = "3") -> np.ndarray:
    """Centroids of scaled vectors after `rounds` rounds."""
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def cluster(df: DataFrame, clusters: int = 8, rounds: int = 10, seed: str = "3", size: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    spark = df.sparkSession
    vectors = saved(scaled(df, size, scale))
    centroids = fit(vectors, clusters, rounds, seed)
    found = saved(assigned(vectors, centroids if len(centroids) else np.zeros((1, size), np.int64)))
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))  # one row
    facts = F.broadcast(sums.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(whole)))
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = 8, rounds: int = 10, seed: str = "3", size: int = 64, scale: int = 1024) -> str:
    """The same in DuckDB, a statement of one round after the other, with every distance."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "dims AS MATERIALIZED (SELECT rid, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM kept)",
        f"drawn AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k FROM kept QUALIFY k < {clusters})",
        "c0 AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS k, p, x AS c FROM drawn JOIN dims USING (rid))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, k, d FROM (SELECT rid, k, sum((x - c) * (x - c)) AS d FROM dims JOIN c{r} USING (p) GROUP BY rid, k)
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS c FROM (SELECT k, p, sum(x) AS s, count(*) AS n FROM a{r} JOIN dims USING (rid) GROUP BY k, p)
                UNION ALL SELECT k, p, c FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))"""
            )
    return f"""WITH {", ".join(parts)}, named AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} JOIN kept USING (rid) JOIN named USING (k)"""


ORACLE_SQL = oracle_sql()
