"""Slots and holds as a stream: a state machine for each slot, with timers.

Operations (slot, at, tie, kind, who, key, starts; times in seconds) arrive in files; `time` is their event time. Each slot's
state is a row in the state store. A hold sets a timer for its end: when the watermark passes it the slot
is free again and a row tells so, without an operation having to come. A second timer, `keep` seconds after
the slot's start, drops its state. Operations of a batch are taken in order of time and tie; one
that is older than the last one decided on its slot is told as late and changes nothing, and one older than
the watermark does not come this far (the stream's progress counts it).

The state store is RocksDB, so slots need not fit in memory; the stream sets no limit to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("who", T.StringType()), T.StructField("until", T.LongType()), T.StructField("key", T.StringType()), T.StructField("last", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("drop", T.LongType())])
RESULT = T.StructType([T.StructField("slot", T.LongType()), T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("result", T.StringType()), T.StructField("status", T.StringType())])


def decide(status: str, who: str | None, until: int, key: str | None, op, ttl: int) -> tuple[tuple, str]:
    """((status, who, until, key), result) after one operation."""
    if status == "HELD" and until <= op.at:
        status, who = "FREE", None
    same, ahead = (status, who, until, key), op.starts > op.at
    if op.kind == "hold":
        return (("HELD", op.who, op.at + ttl, key), "held") if status == "FREE" and ahead else (same, "taken")
    if op.kind == "release":
        return (("FREE", None, 0, key), "released") if status == "HELD" and who == op.who else (same, "not_held")
    if op.kind == "book":
        if status == "BOOKED":
            return same, "booked" if key == op.key else "taken"
        return (("BOOKED", op.who, 0, op.key), "booked") if ahead and (status == "FREE" or who == op.who) else (same, "taken")
    if status == "BOOKED" and key == op.key:
        return ("FREE" if ahead else "CANCELLED", None, 0, None), "cancelled"
    return same, "nothing"


class Slots(StatefulProcessor):
    def __init__(self, ttl: int, keep: int):
        self.ttl, self.keep = ttl, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, who, until, name, last, tie, drop = self.state.get() if self.state.exists() else ("FREE", None, 0, None, -(1 << 62), -1, None)
        out = []
        for op in pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable").itertuples(index=False):
            if (op.at, op.tie) <= (last, tie):
                out.append((key[0], op.at, op.tie, op.kind, "late", status))
                continue
            before = until if status == "HELD" else None
            (status, who, until, name), result = decide(status, who, until, name, op, self.ttl)
            last, tie = int(op.at), int(op.tie)
            after = until if status == "HELD" else None
            if before != after:
                if before is not None:
                    self.handle.deleteTimer(before * 1000)
                if after is not None:
                    self.handle.registerTimer(after * 1000)
            if drop is None:
                drop = int(op.starts) + self.keep
                self.handle.registerTimer(drop * 1000)
            out.append((key[0], op.at, op.tie, op.kind, result, status))
        self.state.update((status, who, int(until), name, last, tie, drop))
        yield pd.DataFrame(out, columns=RESULT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if not self.state.exists():
            return
        status, who, until, name, last, tie, drop = self.state.get()
        if drop is not None and now >= drop:
            self.state.clear()
            yield pd.DataFrame([(key[0], now, None, "timer", "dropped", None)], columns=RESULT.names).astype({"tie": "Int64"})
        elif status == "HELD" and until <= now:
            self.state.update(("FREE", None, 0, name, last, tie, drop))
            yield pd.DataFrame([(key[0], now, None, "timer", "expired", "FREE")], columns=RESULT.names).astype({"tie": "Int64"})

    def close(self) -> None:
        pass


def slot_stream(ops: DataFrame, ttl: int, keep: int = 10 * 86_400, late: str = "1 second") -> DataFrame:
    """RESULT rows: what came of every operation, and of every timer. `ops` is a stream with a timestamp `time`."""
    timed = ops.withWatermark("time", late)
    return timed.groupBy("slot").transformWithStateInPandas(Slots(ttl, keep), outputStructType=RESULT, outputMode="append", timeMode="eventTime")


def run_slots(spark: SparkSession, ops: DataFrame, ttl: int, place: str, keep: int = 10 * 86_400, late: str = "1 second") -> DataFrame:
    """The results of everything that is there by now, written under `place`; calling it again goes on where it ended."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        out = slot_stream(ops, ttl, keep, late).writeStream.format("parquet").outputMode("append").option("path", f"{place}/results").option("checkpointLocation", f"{place}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(RESULT).parquet(f"{place}/results")


def from_seconds(at: Column) -> Column:
    """Event time of seconds since the epoch."""
    return F.timestamp_seconds(at)
