"""Reading tables, mapping Arrow batches and cutting lineage, as every corpus operator does it."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of strings that Python code is given at a time.
SLICE = 2 << 20
#: Rows that Spark hands Python at a time. It is a setting of the session, read when a query runs, and texts are long:
#: batches of Spark's default of 10,000 rows hold too much. release() sets it back.
BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Setting that lets Spark drop a query's shuffle files when the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_tables: list[tuple[SparkSession, str]] = []
_lowered: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, unless their PYTHONPATH names it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted((root / "binsift").rglob("*.py")):
            z.write(p, p.relative_to(root))
    path = Path(tempfile.mkdtemp(prefix="binsift-"), "binsift.zip")
    path.write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def trim() -> None:
    """Give free memory back to the system: Spark keeps Python workers, and later stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of strings, so that Python objects made of them stay few."""
    for b in batches:
        size = np.full(b.num_rows, 16, dtype=np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
                size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - 1) // limit
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(part, part[lo], "right"))
            yield b.slice(lo, hi - lo)
            lo = hi


def arrow_map(df: DataFrame, fn: Mapper, schema: str | StructType) -> DataFrame:
    """mapInArrow over small slices of small batches, with the package on the executors. Lowers BATCH_ROWS in the session."""
    spark = df.sparkSession
    ship(spark)
    if int(before := spark.conf.get(BATCH_ROWS)) > MOST_ROWS:
        _lowered.append((spark, before))
        spark.conf.set(BATCH_ROWS, MOST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(in_slices(batches))
        trim()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in local mode may leave it unset: it has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="binsift-shared-")
    return f"file://{shared_dir.own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that the caller writes; release() deletes it."""
    path = f"{shared_dir(spark)}/binsift-{name}"
    _tables.append((spark, path))
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: no lineage, nothing recomputed, lost executors cost nothing.
    The shuffle files of the query that made it go when it is written; later queries read the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/binsift-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete the tables that operators wrote to the shared folder and set BATCH_ROWS back. Call it when results are
    written: DataFrames made before can't be read after. At the latest it happens when the interpreter ends."""
    while _lowered:
        spark, before = _lowered.pop()
        try:
            spark.conf.set(BATCH_ROWS, before)
        except Exception:  # the session has ended  # noqa: BLE001
            pass
    while _tables:
        spark, path = _tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before the interpreter  # noqa: BLE001
            pass


def fold(doc_id: str = "doc_id", mod: int = 3) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def sample_of_labels(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[int, int]]:
    """(doc_id, label) of at most per_class ids of each of the labels 0 and 1 that have a text of 1 to max_chars characters,
    in the order of a hash of the id. Only ids are joined, before any is left out for the bound."""
    usable = docs.filter(F.length(F.col("text").cast("string")).between(1, max_chars)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    given = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("_label")).distinct()
    held = saved(given.join(usable, "doc_id", "left_semi"))
    rows: list[tuple[int, int]] = []
    for value in (0, 1):
        part = held.filter(F.col("_label") == value).select("doc_id")
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows += [(r.doc_id, value) for r in part.collect()]
    return rows


def texts_of(docs: DataFrame, rows: list[tuple[int, int]], max_chars: int) -> list[tuple[str, int]]:
    """Whole texts of those ids that have 1 to max_chars characters, with their labels, by doc_id: of rows that repeat an
    id, however many, the one whose text has the least hash, so that what comes to the driver stays as bounded as rows."""
    wanted = docs.sparkSession.createDataFrame(rows, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = texts.join(F.broadcast(wanted), "doc_id").filter(F.length("text").between(1, max_chars))
    got = some.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return [(r.text, r.label) for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.label))]
