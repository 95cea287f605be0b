"""Function records as a stream: first-wins deduplication with bounded state, running counters, and batch stages on what
each micro-batch adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.records import FUNCTION


def functions(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Functions of the JSON lines files that arrive in a folder, with binary_id (the file's name) and seen_at."""
    raw = spark.readStream.schema(FUNCTION).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("binary_id"), "*", F.col("_metadata.file_modification_time").alias("seen_at"))


def first_of_each(stream: DataFrame, keys: tuple[str, ...] = ("binary_id", "fingerprint"), late: str = "1 hour") -> DataFrame:
    """The first function of each fingerprint; the state of a key is dropped once the watermark has passed it."""
    return stream.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(list(keys))


def op_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Operations seen in each tumbling window by mnemonic."""
    rows = stream.withWatermark("seen_at", late).select("seen_at", F.explode("ops.op").alias("op"))
    return rows.groupBy(F.window("seen_at", window), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")


def each_batch(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Run a batch stage on every micro-batch; a repeated batch replaces its own folder, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
