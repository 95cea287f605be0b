"""A table function that makes operations of JSON lines, for SQL: `operations_of(TABLE(...) PARTITION BY (file, name) ORDER BY n)`.

    tables.register(spark)
    spark.sql('''SELECT * FROM operations_of(
        TABLE(SELECT file, n, get_json_object(line, '$.name') AS name, line FROM lines) PARTITION BY (file, name) ORDER BY n)''')

Input rows are lines (file, n, name, line) with their number in the file; a partition holds the lines of one function name
of one file, of which the last that can be read stays, so a task holds one function at a time. Rows are those of
`ops.flat(read_functions(...))`, with call targets as recorded: `operations` cleans them and is what most callers want.

Defined results: lines that can't be read give nothing and replace nothing; a line without a name is the function `func_n`;
a function without operations gives no rows. Bookkeeping operations are dropped and the rest numbered anew from 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.dims import SKIPPED_OPS
from ..functions.names import clean_name
from ..operators.shipping import ship

NAME = "operations_of"
ROWS = "file string, fn string, seq int, op string, target string, out_var string, args array<string>, sizes array<int>"
CALLS = ("CALL", "CALLIND")


def rows_of(file: str, fn: str, operations: list | None) -> Iterator[tuple]:
    """Flat operations of one function's record."""
    kept = [o for o in operations or [] if isinstance(o, dict) and o.get("op") not in SKIPPED_OPS and o.get("op") is not None]
    for seq, o in enumerate(kept):
        inputs = [v or {} for v in o.get("inputs") or []]
        target = None
        if o["op"] in CALLS:
            target, inputs = (inputs[0].get("name") if inputs else None), inputs[1:]
        yield file, fn, seq, o["op"], target, (o.get("output") or {}).get("name"), [v.get("name") for v in inputs], [v.get("size") for v in inputs]


class FunctionOperations:
    """Operations of the last readable line of each partition; lines without a name each for themselves."""

    def __init__(self) -> None:
        self.last: tuple[str, dict] | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        try:
            record = json.loads(row["line"] or "")
        except ValueError:
            return
        if not isinstance(record, dict):
            return
        if record.get("name") is None:
            yield from rows_of(row["file"], f"func_{row['n']}", record.get("ops"))
        else:
            self.last = row["file"], record

    def terminate(self) -> Iterator[tuple]:
        if self.last:
            file, record = self.last
            yield from rows_of(file, record["name"], record.get("ops"))


def register(spark: SparkSession, name: str = NAME) -> None:
    """Make the table function known to the session's SQL."""
    ship(spark)
    spark.udtf.register(name, udtf(FunctionOperations, returnType=ROWS))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line of text files. Numbers ascend within a file."""
    raw = spark.read.text(path)
    return raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def operations(rows: DataFrame) -> DataFrame:
    """Flat operations (file, fn, seq, op, callee, out_var, args, sizes) of lines (file, n, line), through SQL."""
    spark = rows.sparkSession
    register(spark)
    got = spark.sql(
        f"SELECT t.* FROM {NAME}(TABLE(SELECT file, n, get_json_object(line, '$.name') AS name, line FROM {{rows}}) PARTITION BY (file, name) ORDER BY n) t",
        rows=rows,
    )
    callee = F.when(F.col("op").isin(*CALLS), clean_name(F.col("target"), F.col("op") == "CALLIND"))
    return got.select("file", "fn", "seq", "op", callee.alias("callee"), "out_var", "args", "sizes")
