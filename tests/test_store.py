from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from binsift.operators import store

SCHEMA = "fn string, v int"
COUNTS = "fn string, seen_count long, conf int"


@pytest.fixture
def table(spark):
    return lambda *rows, schema=SCHEMA: spark.createDataFrame(list(rows), schema).coalesce(1)


@pytest.fixture
def made(spark, tmp_path):
    return lambda: store.Store(spark, f"file://{tmp_path}/store")


def rows(s, name="t", schema=SCHEMA):
    return sorted(map(tuple, s.read(name, schema).collect()))


def test_two_writers_one_gets_an_error(made, table):
    a, b = made(), made()
    a.write("t", table(("x", 1)))
    old, same = a.read("t", SCHEMA), b.read("t", SCHEMA)
    a.write("t", old.unionByName(table(("a", 1))))
    with pytest.raises(store.ConflictError):
        b.write("t", same.unionByName(table(("b", 1))))
    assert rows(made()) == [("a", 1), ("x", 1)]
    b.write("t", b.read("t", SCHEMA).unionByName(table(("b", 1))))
    assert rows(made()) == [("a", 1), ("b", 1), ("x", 1)]


def test_concurrent_upserts_all_survive(made, table):
    made().write("t", table(("x", 0)))
    done, errors = threading.Barrier(4), []

    def writer(k):
        try:
            s, mine = made(), table((f"k{k}", k), ("x", k))
            done.wait()
            s.upsert("t", mine, ["fn"], "v", SCHEMA)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and rows(made()) == [("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3), ("x", 3)]


def test_a_change_writes_its_own_rows_only(made, table, spark, tmp_path):
    s = made()
    s.write("t", spark.range(50_000).select(F.concat(F.lit("f"), "id").alias("fn"), F.lit(1).alias("v")))
    whole = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    s.upsert("t", table(("f7", 2)), ["fn"], "v", SCHEMA)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) - whole < whole / 50
    assert s.read("t", SCHEMA).filter("v = 2").count() == 1 and s.read("t", SCHEMA).count() == 50_000


def test_deltas_are_applied_in_order_and_compacted(made, table, monkeypatch):
    monkeypatch.setattr(store, "MOST_DELTAS", 3)
    s = made()
    s.count("c", table(("a", 1, 5), ("b", 1, 1), schema=COUNTS), ["fn"], COUNTS)  # the first of a table may be a delta
    s.count("c", table(("a", 2, 3), schema=COUNTS), ["fn"], COUNTS)
    s.delete("c", table(("b", 0)), ["fn"], COUNTS)
    s.count("c", table(("b", 4, 2), ("a", 1, 9), schema=COUNTS), ["fn"], COUNTS)
    assert rows(s, "c", COUNTS) == [("a", 4, 9), ("b", 4, 2)]
    assert [s._entry("c", n)["does"] for n in s._numbers("c")] == ["count", "count", "delete", "count", "whole"]
    s.delete("c", table(("a", 0)), ["fn"], COUNTS)
    assert rows(made(), "c", COUNTS) == [("b", 4, 2)]
    assert s.vacuum("c", whole=1) == 4 and rows(made(), "c", COUNTS) == [("b", 4, 2)] and s.vacuum("c", whole=1) == 0


def test_an_older_version_does_not_replace(made, table):
    s = made()
    s.upsert("t", table(("a", 5)), ["fn"], "v", SCHEMA)
    s.upsert("t", table(("a", 3), ("b", 1)), ["fn"], "v", SCHEMA)
    assert rows(s) == [("a", 5), ("b", 1)]


def test_a_failed_write_changes_nothing(made, table):
    s = made()
    s.write("t", table(("a", 1)))
    with pytest.raises(Exception, match="broken"):
        s.write("t", table(("a", 2)).withColumn("v", F.raise_error(F.lit("broken")).cast("int")))
    assert rows(s) == [("a", 1)] and s.vacuum("t") <= 1 and rows(s) == [("a", 1)]
    assert rows(s, "none") == [] and s.vacuum("none") == 0
