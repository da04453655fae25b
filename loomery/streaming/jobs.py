"""Streams: hourly rollups with additive upserts, sessions by day, idempotent intake, limits with state.

Sources are folders of files; all jobs run once over what is there (availableNow) or for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbers import LATENCY_BOUNDS, bin_of, half_up
from ..sources.tables import add_counters


def read_events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """The files of a folder that a pattern names, or the table of that very name: one file, or a folder of them."""
    read = spark.readStream.schema(schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if "*" not in pattern and fs.exists(where) and fs.getFileStatus(where).isDirectory():
        return read.parquet(f"{folder}/{pattern}")
    return read.option("pathGlobFilter", pattern).parquet(folder)


def hourly(events: DataFrame, ts: str = "ts", endpoint: str = "event_type", value: str = "value") -> DataFrame:
    """Counters of a batch by hour and endpoint; sums of batches are sums of all."""
    bins = bin_of(F.col(value))
    counted = [F.count_if(bins == i).alias(f"b{i}") for i in range(len(LATENCY_BOUNDS) + 1)]
    return events.groupBy(F.date_trunc("hour", ts).alias("hour"), F.col(endpoint).alias("endpoint")).agg(F.count(F.lit(1)).alias("n"), F.sum(half_up(F.col(value) * 100).cast("long")).alias("total_cs"), *counted)


class Rollup:
    """An additive upsert as a foreachBatch sink.

    Every batch writes its own counters, and nothing else, under its batch id; a batch that is repeated
    after a failure writes the same again, so its counts are added once. Every `merge_every` batches the
    counters so far are summed into a base table, and what it holds is not read again. Tables are only
    read once they are complete.
    """

    def __init__(self, path: str, keys: list[str], merge_every: int = 100):
        self.path, self.keys, self.merge_every = path.rstrip("/"), keys, merge_every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        hourly(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self._sum(batch.sparkSession, batch_id).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")

    def _ids(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches up to which there is a complete table of a kind."""
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _sum(self, spark: SparkSession, upto: int) -> DataFrame:
        bases = [i for i in self._ids(spark, "base") if i < upto]
        base = max(bases, default=-1)
        parts = [f"{self.path}/batch={i}" for i in self._ids(spark, "batch") if base < i <= upto] + ([f"{self.path}/base={base}"] if bases else [])
        rows = spark.read.option("basePath", self.path).parquet(*parts).drop("batch", "base")
        return add_counters(rows, rows.limit(0), self.keys)

    def latest(self, spark: SparkSession) -> DataFrame:
        return self._sum(spark, max(self._ids(spark, "batch")))


def run_rollup(spark: SparkSession, folder: str, schema: T.StructType, shared: str, pattern: str = "*.parquet") -> DataFrame:
    """The hourly rollup of everything in a folder, through the stream."""
    place = f"{shared.rstrip('/')}/loomery-stream/{uuid.uuid4().hex}"
    sink = Rollup(f"{place}/table", ["hour", "endpoint"])
    events = read_events(spark, folder, schema, pattern)
    events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.latest(spark)


def windowed(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling windows with a watermark; rows later than `late` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key)).agg(F.count(F.lit(1)).alias("n"))


def hours_of_minutes(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """(hour, key, n, busiest, minutes): two windows in a row under one watermark, minutes first and hours made of them.

    An hour is told once the watermark has passed its end: n events in all, most in one minute, and how many
    minutes had any. State is open minutes and hours only.
    """
    timed = events.withWatermark(ts, late)
    minutes = timed.groupBy(F.window(ts, "1 minute"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    hours = minutes.groupBy(F.window(F.window_time("window"), "1 hour").alias("w"), F.col(key)).agg(F.sum("n").alias("n"), F.max("n").alias("busiest"), F.count(F.lit(1)).alias("minutes"))
    return hours.select(F.col("w.start").alias("hour"), key, "n", "busiest", "minutes")


def run_hours(events: DataFrame, place: str, ts: str, key: str, late: str = "10 minutes") -> tuple[DataFrame, int]:
    """(the hours that are closed by now, rows that came too late for their minute); calling it again goes on where it ended."""
    spark = events.sparkSession
    made = hours_of_minutes(events, ts, key, late)
    stream = made.writeStream.format("parquet").outputMode("append").option("path", f"{place}/hours").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    dropped = sum(int(op["numRowsDroppedByWatermark"]) for p in stream.recentProgress for op in p["stateOperators"])
    return spark.read.schema(made.schema).parquet(f"{place}/hours"), dropped


def once(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Each id once within the watermark, as for repeated deliveries."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


LIMIT_STATE = T.StructType([T.StructField("held", T.ArrayType(T.LongType()))])


def sliding_limit(events: DataFrame, key: str, at: str, span: int, most: int, forget: bool = False) -> DataFrame:
    """accepted, with the times of accepted requests as state.

    forget: drop a key that is silent for `span` seconds of processing time. For streams that run on;
    one that runs once over what is there would wait for the timeouts.
    """
    out = T.StructType([events.schema[key], events.schema[at], T.StructField("accepted", T.BooleanType())])

    def step(keys: tuple, blocks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(blocks).sort_values(at, kind="stable")
        told = []
        for now in rows[at]:
            held = [x for x in held if x > now - span]
            fine = len(held) < most
            if fine:
                held.append(int(now))
            told.append((keys[0], int(now), fine))
        state.update((held,))
        if forget:
            state.setTimeoutDuration(span * 1000)
        yield pd.DataFrame(told, columns=[key, at, "accepted"])

    return events.groupBy(key).applyInPandasWithState(step, out, LIMIT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
