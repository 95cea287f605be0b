"""Persistent tables that grow by deltas, and what deltas do to immutable DataFrames: upserts are a union and an
aggregation, deletes an anti join."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Deltas after which a table is written whole again.
MOST_DELTAS = 16
#: One process commits one entry at a time; between processes the file system decides.
_committing = threading.Lock()


class ConflictError(RuntimeError):
    """Somebody else committed to a table since it was read."""


class Store:
    """A folder of tables, each a log of numbered entries over immutable Parquet folders.

    An entry says what its rows do to the table: be it (`whole`), replace rows by key where they are newer (`upsert`), add
    counts by key (`count`) or remove keys (`delete`). A change writes its own rows and one entry, so it costs what it
    brings, and a reader applies the entries since the last whole one. Every MOST_DELTAS entries the table is written whole.

    Rows are written first, then the entry is moved to the next number, which only one writer gets: the file system must
    refuse to move a file onto another (HDFS and its like do; on a local one writers must share the process). Of two
    writers the second takes the next number if its change is a delta, for deltas mean the same whatever they are applied
    to; replacing a table that has changed since this Store read it is a ConflictError instead. A failed write leaves rows
    that no entry names, which `vacuum` deletes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: dict[str, int] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- the log
    def _files(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _numbers(self, name: str) -> list[int]:
        return [int(f[:-5]) for f in self._files(f"{self.root}/{name}/log") if f.endswith(".json") and not f.startswith((".", "_"))]

    def _entry(self, name: str, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}/log/{number:012d}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _since_whole(self, name: str, numbers: list[int]) -> list[dict]:
        """Entries that make the table, the last whole one first."""
        entries: list[dict] = []
        for n in reversed(numbers):
            entries.insert(0, self._entry(name, n))
            if entries[0]["does"] == "whole":
                break
        return entries

    def _commit(self, name: str, entry: dict, number: int) -> bool:
        """Whether the entry got the number."""
        made = self._path(f"{self.root}/{name}/log/_{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target = self._path(f"{self.root}/{name}/log/{number:012d}.json")
        with _committing:
            if not self._fs.exists(target) and self._fs.rename(made, target):
                return True
        self._fs.delete(made, False)
        return False

    def _written(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/{name}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    # -- tables
    def read(self, name: str, schema: str) -> DataFrame:
        """The table as it is now, or no rows of the schema."""
        numbers = self._numbers(name)
        self._seen[name] = numbers[-1] if numbers else -1
        return self._applied(self._since_whole(name, numbers), schema)

    def _applied(self, entries: list[dict], schema: str) -> DataFrame:
        table = self.spark.createDataFrame([], schema)
        for e in entries:
            keys = e.get("keys", [])
            if e["does"] == "delete":
                gone = self.spark.read.parquet(e["rows"])
                table = cleared(table, gone, keys)
                continue
            rows = self.spark.read.schema(schema).parquet(e["rows"])
            table = rows if e["does"] == "whole" else latest(table, rows, keys, e["column"]) if e["does"] == "upsert" else merged(table, rows, keys, e["column"])
        return table.select(*self.spark.createDataFrame([], schema).columns)

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the table. A ConflictError if it has changed since this Store read it, or since the call began."""
        numbers = self._numbers(name)
        last = self._seen.get(name, numbers[-1] if numbers else -1)
        if numbers and numbers[-1] != last:
            raise ConflictError(f"{name} is at {numbers[-1]}, was read at {last}")
        if not self._commit(name, {"does": "whole", "rows": self._written(name, rows)}, last + 1):
            raise ConflictError(f"{name} has changed since {last}")
        self._seen[name] = last + 1

    def seed(self, name: str, rows: DataFrame, schema: str) -> DataFrame:
        """Write rows only if the table is empty. Of two that seed at once the first one's rows stand."""
        if not self._numbers(name):
            self._commit(name, {"does": "whole", "rows": self._written(name, rows)}, 0)
        return self.read(name, schema)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], version: str, schema: str) -> None:
        """Replace by key, where the version is greater than that of the row that is there."""
        self._delta(name, {"does": "upsert", "rows": self._written(name, rows), "keys": list(keys), "column": version}, schema)

    def count(self, name: str, rows: DataFrame, keys: Sequence[str], schema: str, count: str = "seen_count") -> None:
        """Add counts by key; other columns keep their greatest value."""
        self._delta(name, {"does": "count", "rows": self._written(name, rows), "keys": list(keys), "column": count}, schema)

    def delete(self, name: str, gone: DataFrame, keys: Sequence[str], schema: str) -> None:
        """Remove the keys of gone from what was written before."""
        self._delta(name, {"does": "delete", "rows": self._written(name, gone.select(*keys).distinct()), "keys": list(keys)}, schema)

    def _delta(self, name: str, entry: dict, schema: str) -> None:
        numbers = self._numbers(name)
        n = numbers[-1] + 1 if numbers else 0
        while not self._commit(name, entry, n):
            n += 1
        if len(self._since_whole(name, self._numbers(name))) > MOST_DELTAS:
            self.compact(name, schema)

    def compact(self, name: str, schema: str) -> bool:
        """Write the table whole, unless somebody commits meanwhile; then a later change will."""
        numbers = self._numbers(name)
        entries = self._since_whole(name, numbers)
        if len(entries) < 2:
            return False
        return self._commit(name, {"does": "whole", "rows": self._written(name, self._applied(entries, schema))}, numbers[-1] + 1)

    def vacuum(self, name: str, whole: int = 2) -> int:
        """Delete entries and rows older than the last `whole` whole versions, and rows that no entry names; the number of
        folders deleted. No writer or reader of older versions may be at work."""
        numbers = self._numbers(name)
        entries = {n: self._entry(name, n) for n in numbers}
        bases = [n for n in numbers if entries[n]["does"] == "whole"]
        first = bases[-whole] if len(bases) >= whole else numbers[0] if numbers else 0
        kept = {entries[n]["rows"].rsplit("/", 1)[-1] for n in numbers if n >= first}
        for n in numbers:
            if n < first:
                self._fs.delete(self._path(f"{self.root}/{name}/log/{n:012d}.json"), False)
        gone = [f for f in self._files(f"{self.root}/{name}/rows") if f not in kept]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/{name}/rows/{f}"), True)
        return len(gone)


def latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Replace by key: of all rows of a key the one of the greatest version stays."""
    rows = old.unionByName(new)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.col(version)).alias("_b"))
    return best.select(*keys, "_b.*")


def counted(events: DataFrame, keys: Sequence[str], order: str, confidence: str | None = None, text: str | None = None) -> DataFrame:
    """Upsert of events: how many there were of each key, the greatest confidence, the last text that is not empty."""
    extra = []
    if confidence:
        extra.append(F.max(confidence).alias(confidence))
    if text:
        some = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(text))
        extra.append(F.max_by(some, F.when(some.isNotNull(), F.col(order))).alias(text))
    return events.groupBy(*keys).agg(F.count("*").alias("seen_count"), *extra)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str = "seen_count") -> DataFrame:
    """Counts of both tables added by key; other columns keep their greatest value."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in (*keys, count)]
    return rows.groupBy(*keys).agg(F.sum(count).alias(count), *[F.max(c).alias(c) for c in rest])


def cleared(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows without the keys of gone."""
    return rows.join(gone.select(*keys), list(keys), "left_anti")


def put_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value metadata (key, value, version; values are JSON) with the newest value of each key."""
    return latest(old, new, ["key"], "version")


def metadata(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """The value of a key as fields, one row; none where the key isn't set or its value can't be read."""
    return rows.filter(F.col("key") == key).select(F.from_json("value", schema).alias("v")).filter("v IS NOT NULL").select("v.*")


def learned_roles(rules: DataFrame) -> DataFrame:
    """fn and role of the functions that a role was learned of, the surest of each."""
    return rules.filter("role IS NOT NULL").groupBy("fn").agg(F.max_by("role", F.struct("confidence", "role")).alias("role"))
