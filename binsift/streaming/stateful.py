"""Stateful processors: running counters of events, and the first record of each fingerprint, with timers that let go of
state that nothing comes for any more.

Both give changes to be upserted, not totals to be appended: a counter's row is named by its key and the time its state
began, and a later row of that name replaces an earlier one; a fingerprint's row is replaced by one of a lesser order. So
batches that are run again after a failure change nothing, and what arrives late and out of order ends in the result of
one batch over everything: `totals` and `firsts` make it from the changes. When event time has passed a key's last event by
`idle`, its timer drops the state; if it comes back, it begins a new row, and totals add rows up. For fingerprints `idle`
must be at least as long as records may be late, else two rows of a fingerprint are emitted, of which `firsts` still takes
the lesser.

Rows behind the watermark are dropped by Spark before they get here; set `late` to what the sources need. Defined results:
events with a null in a key column are counted under the null key; a null order comes after all others; null or empty
texts and null confidences are no values. The session needs the RocksDB state store (`with_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"
#: Order of a record that has none.
LAST = (1 << 63) - 1


def with_state_store(spark: SparkSession) -> SparkSession:
    """Use the state store that stateful processors need for the queries started from now on."""
    ship(spark)
    spark.conf.set(SETTING, PROVIDER)
    return spark


class _Idle(StatefulProcessor):
    """What both processors do about time: one timer a key, `idle` after its latest event."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def rest(self, seen: pd.Timestamp) -> None:
        """Move the key's timer to `idle` after the latest event met."""
        latest = int(seen.timestamp() * 1000) + self.idle_ms
        timers = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if timers and max(timers) >= latest:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(latest)

    def close(self) -> None:
        pass


class Counter(_Idle):
    """seen_count, greatest confidence and last text of each key's events since its state began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", "since timestamp, seen_count long, confidence double, text string, text_order long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.exists()
        since, n, confidence, text, order = self.state.get() if known else (None, 0, None, None, None)
        seen = None
        for part in rows:  # one Arrow batch of the key's rows after the other
            if not known:
                since = part["seen_at"].min() if since is None else min(since, part["seen_at"].min())
            seen = part["seen_at"].max() if seen is None else max(seen, part["seen_at"].max())
            n += len(part)
            most = part["confidence"].max()
            confidence = confidence if pd.isna(most) else float(most) if confidence is None else max(confidence, float(most))
            told = part[part["text"].notna() & (part["text"] != "") & part["ord"].notna()]
            if len(told):
                last = told.loc[told["ord"] == told["ord"].max()]
                best = (int(last["ord"].iloc[0]), max(last["text"]))
                if order is None or best > (order, text):
                    order, text = best
        self.state.update((since, n, confidence, text, order))
        self.rest(seen)
        yield pd.DataFrame({"key": [key[0]], "since": [since], "seen_count": [n], "confidence": [confidence], "text": [text], "text_order": [order]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())


class First(_Idle):
    """The record of the least order of each key, again whenever one of a lesser order comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first", "ord long, value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, seen = None, None
        for part in rows:
            seen = part["seen_at"].max() if seen is None else max(seen, part["seen_at"].max())
            least = min((LAST if pd.isna(o) else int(o), v) for o, v in zip(part["ord"], part["value"]))
            best = least if best is None else min(best, least)
        self.rest(seen)
        if self.state.exists() and tuple(self.state.get()) <= best:
            return
        self.state.update(best)
        yield pd.DataFrame({"key": [key[0]], "ord": [best[0]], "value": [best[1]]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())


def _key(keys: Sequence[str]) -> Any:
    """One string of the key columns, which they can be read back from."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")


def _keyed(changes: DataFrame, keys: Sequence[str], like: DataFrame, rest: Sequence[str]) -> DataFrame:
    schema = T.StructType([like.schema[k] for k in keys])
    return changes.select(F.from_json("key", schema).alias("_k"), *rest).select("_k.*", *rest)


def running_counts(events: DataFrame, keys: Sequence[str], order: str, confidence: str, text: str, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """Changes of the counters of a stream of events with seen_at: key, since, seen_count, confidence, text, text_order."""
    rows = events.withWatermark("seen_at", late).select(_key(keys), "seen_at", F.col(order).cast("long").alias("ord"), F.col(confidence).cast("double").alias("confidence"), F.col(text).cast("string").alias("text"))
    schema = "key string, since timestamp, seen_count long, confidence double, text string, text_order long"
    return rows.groupBy("key").transformWithStateInPandas(Counter(idle_ms), schema, "Update", "EventTime")


def totals(changes: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    """Counters from their changes: keys, seen_count, confidence, text. like has the types of the keys."""
    last = changes.groupBy("key", "since").agg(F.max_by(F.struct("seen_count", "confidence", "text", "text_order"), "seen_count").alias("c")).select("key", "c.*")
    text = F.max_by("text", F.when(F.col("text").isNotNull(), F.struct("text_order", "text")))
    sums = last.groupBy("key").agg(F.sum("seen_count").alias("seen_count"), F.max("confidence").alias("confidence"), text.alias("text"))
    return _keyed(sums, keys, like, ["seen_count", "confidence", "text"])


def first_records(records: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """Changes of the first records of a stream with seen_at: key, ord, value (JSON of the value columns)."""
    rows = records.withWatermark("seen_at", late).select(_key(keys), "seen_at", F.col(order).cast("long").alias("ord"), F.to_json(F.struct(*values)).alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(First(idle_ms), "key string, ord long, value string", "Update", "EventTime")


def firsts(changes: DataFrame, keys: Sequence[str], values: Sequence[str], like: DataFrame) -> DataFrame:
    """The first record of each key from the changes: keys and values."""
    best = changes.groupBy("key").agg(F.min_by("value", F.struct("ord", "value")).alias("value"))
    schema = T.StructType([like.schema[v] for v in values])
    return _keyed(best.withColumn("v", F.from_json("value", schema)).select("key", "v.*"), keys, like, list(values))
