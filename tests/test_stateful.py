from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from binsift.operators import store
from binsift.streaming import ingest, stateful

EVENTS = "fn string, kind string, seen_at timestamp, event_id long, conf double, note string"


@pytest.fixture
def stream(spark, tmp_path):
    """Batches written one file each, and what a stateful query has emitted after each run over the folder."""
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stateful.with_state_store(spark)

    class Runs:
        n = 0

        def add(self, rows):
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))

        def events(self):
            return spark.read.schema(EVENTS).parquet(str(folder))

        def run(self, make, stage=lambda b: b):
            source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
            q = ingest.each_batch(make(source), stage, str(out), str(checkpoint))
            assert q.awaitTermination(180)
            if q.exception():
                raise q.exception()

        def changes(self):
            return spark.read.parquet(str(out))

    yield Runs()
    spark.conf.set("spark.sql.shuffle.partitions", old)


def at(minute):
    return __import__("datetime").datetime(2024, 1, 1, minute // 60, minute % 60)


def counts(source):
    return stateful.running_counts(source, ["fn", "kind"], "event_id", "conf", "note", late="2 hours", idle_ms=30 * 60_000)


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_counters_of_late_and_repeated_batches_equal_one_batch(stream):
    keys = ["fn", "kind"]
    stream.add([("f", "a", at(10), 3, 0.5, "three"), ("f", "a", at(11), 1, 0.9, "one"), ("g", None, at(12), 2, None, ""), (None, "a", at(12), 9, 0.1, None)])
    stream.run(counts)
    stream.add([("f", "a", at(5), 7, 0.2, ""), ("g", None, at(13), 4, 0.3, "four")])  # late, within the watermark
    stream.add([("h", "b", at(15), 5, 0.4, None)] * 3)
    with pytest.raises(Exception, match="broken"):
        stream.run(counts, lambda b: b.withColumn("since", F.raise_error(F.lit("broken")).cast("timestamp")))
    stream.run(counts)  # the failed batch is run again
    stream.add([("f", "a", at(300), 11, 0.1, "much later")])  # lets the timers of all keys go
    stream.run(counts)
    stream.add([("g", None, at(301), 12, 0.2, "back again"), ("f", "a", at(302), 13, 1.0, None)])
    stream.run(counts)
    stream.run(counts)
    got = stateful.totals(stream.changes(), keys, stream.events())
    want = store.counted(stream.events(), keys, "event_id", "conf", "note").withColumnsRenamed({"conf": "confidence", "note": "text"})
    columns = ["fn", "kind", "seen_count", "confidence", "text"]
    assert rows(got, *columns) == rows(want, *columns)
    began = {(r.key, r.since) for r in stream.changes().select("key", "since").distinct().collect()}
    assert len(began) > got.count()  # some key's state was let go and began again


def first(source):
    return stateful.first_records(source, ["kind"], "event_id", ["fn", "note"], late="2 hours", idle_ms=60 * 60_000)


def test_first_of_each_fingerprint_whatever_the_order_of_arrival(stream):
    stream.add([("f", "x", at(10), 5, 0.5, "five"), ("g", "y", at(10), 2, 0.5, "two"), ("h", None, at(10), None, 0.5, "none")])
    stream.run(first)
    stream.add([("e", "x", at(3), 1, 0.5, "one"), ("z", "y", at(12), 8, 0.5, "eight")])
    stream.run(first)
    stream.add([("e", "x", at(3), 1, 0.5, "one"), ("k", None, at(14), 4, 0.5, "four")])  # one more time
    stream.run(first)
    got = stateful.firsts(stream.changes(), ["kind"], ["fn", "note"], stream.events())
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("x", "e", "one"), ("y", "g", "two"), (None, "k", "four")]))
    assert stream.changes().count() == 5  # three firsts and two corrections
