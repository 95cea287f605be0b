"""Function records as nested JSON lines: schema, tolerant and strict readers, writers, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARNODE = T.StructType([T.StructField("name", T.StringType()), T.StructField("space", T.StringType()), T.StructField("size", T.IntegerType())])
OP = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("addr", T.StringType()), T.StructField("output", VARNODE), T.StructField("inputs", T.ArrayType(VARNODE))])
FLAGS = ["has_load", "has_store", "has_loop", "has_indirect_call", "has_int_arith", "has_pointer_arith", "is_validator", "calls_dangerous_import", "has_mem_and_call"]
FUNCTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("entry_addr", T.StringType()),
        T.StructField("prototype", T.StringType()),
        T.StructField("size_bytes", T.IntegerType()),
        T.StructField("decompile_time", T.DoubleType()),
        T.StructField("call_sites", T.ArrayType(T.StringType())),
        T.StructField("flags", T.StructType([T.StructField(f, T.BooleanType()) for f in FLAGS])),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("ops", T.ArrayType(OP)),
    ]
)
RANKED = T.StructType(
    [
        *(f for f in FUNCTION.fields if f.name not in ("size_bytes", "decompile_time")),
        T.StructField("score", T.DoubleType()),
        T.StructField("discarded", T.BooleanType()),
        T.StructField("discard_reason", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("op_count", T.IntegerType()),
        T.StructField("reachability_score", T.DoubleType()),
        T.StructField("semantic_role", T.StringType()),
        T.StructField("role_confidence", T.DoubleType()),
        T.StructField("expanded", T.BooleanType()),
    ]
)


def read_functions(spark: SparkSession, path: str, strict: bool = False, binary_id: str | None = None) -> DataFrame:
    """Functions of JSON lines. Tolerant: blank and broken lines go (strict: they fail the read), missing fields get
    defaults. One row per (binary_id, name): of repeated names the last line of the file stays."""
    schema = FUNCTION if strict else T.StructType([*FUNCTION.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    raw = (reader if strict else reader.option("columnNameOfCorruptRecord", "_corrupt")).json(path)
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    if not strict:
        placed = placed.filter("_corrupt IS NULL").drop("_corrupt")
    filled = placed.select(
        (F.lit(binary_id) if binary_id else F.element_at(F.split("_file", "/"), -1)).alias("binary_id"),
        F.coalesce("name", F.concat(F.lit("func_"), F.col("_line").cast("string"))).alias("name"),
        F.coalesce("entry_addr", F.lit("0x0")).alias("entry_addr"),
        F.coalesce("prototype", F.lit("")).alias("prototype"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.coalesce("decompile_time", F.lit(0.0)).alias("decompile_time"),
        F.coalesce("call_sites", F.array().cast("array<string>")).alias("call_sites"),
        "flags",
        "fingerprint",
        F.coalesce("ops", F.array().cast(T.ArrayType(OP))).alias("ops"),
        "_line",
    )
    last = filled.groupBy("binary_id", "name").agg(F.max("_line").alias("_line"))
    return filled.join(last, ["binary_id", "name", "_line"]).drop("_line")


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Ranked functions that were not discarded; a missing reachability score is 1."""
    return spark.read.schema(RANKED).json(path).filter(~F.coalesce("discarded", F.lit(False))).withColumn("reachability_score", F.coalesce("reachability_score", F.lit(1.0)))


def replaced(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write df in place of what is at path: to a folder beside it first, then by renames, so that a failed write leaves
    the old files."""
    spark = df.sparkSession
    fresh, old = f"{path}._new-{uuid.uuid4().hex}", f"{path}._old-{uuid.uuid4().hex}"
    df.write.format(fmt).save(fresh)
    as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(as_path(path)):
        fs.rename(as_path(path), as_path(old))
    fs.rename(as_path(fresh), as_path(path))
    fs.delete(as_path(old), True)


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Ranked functions as JSON lines: score to four places, confidences to three."""
    replaced(ranked.withColumn("score", F.round("score", 4)).withColumn("role_confidence", F.round("role_confidence", 3)), path)


def write_functions(functions: DataFrame, path: str) -> None:
    """Functions as JSON lines."""
    replaced(functions, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a non-empty file or folder, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getContentSummary(p).getLength() > 0


def resumed(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written first unless it is there already and force is off."""
    if force or not exists(spark, path):
        replaced(make(), path, "parquet")
    return spark.read.parquet(path)


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON of a schema; no rows where the file is missing."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_labels(spark: SparkSession, path: str, positive_only: bool = True) -> DataFrame:
    """Ground truth CSV (bug_id, function_name, label); only label 1 unless told otherwise."""
    rows = spark.read.option("header", True).csv(path)
    return rows.filter(F.trim("label") == "1") if positive_only else rows


def read_datasets(spark: SparkSession, root: str, variants: tuple[str, ...] = ("vuln_O0", "vuln_O2", "")) -> DataFrame:
    """Functions of every library folder under root, each from the first of its variants that exists."""
    text = spark.read.schema(FUNCTION).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root)
    rest = F.replace(F.col("_metadata.file_path"), F.lit(root.rstrip("/") + "/"), F.lit(""))
    named = text.select("*", F.regexp_replace(rest, "^file:(//)?", "").alias("_rest")).withColumn("library", F.split_part("_rest", F.lit("/"), F.lit(1)))
    order = F.lit(len(variants))
    for i in reversed(range(len(variants))):
        order = F.when(F.col("_rest").contains(f"/{variants[i]}/") if variants[i] else F.lit(True), i).otherwise(order)
    ranked = named.withColumn("_order", order)
    first = ranked.groupBy("library").agg(F.min("_order").alias("_order"))
    return ranked.join(first, ["library", "_order"]).drop("_rest", "_order")
