"""Queries that run a stream over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming.jobs import read_events, run_hours, run_rollup
from ..streaming.slots import from_seconds, run_slots
from .records import slot_work
from .registry import SQL, Tables, query

BINS = "CASE WHEN value <= 5 THEN 0 WHEN value <= 10 THEN 1 WHEN value <= 25 THEN 2 WHEN value <= 50 THEN 3 WHEN value <= 75 THEN 4 WHEN value <= 100 THEN 5 WHEN value <= 150 THEN 6 WHEN value <= 200 THEN 7 WHEN value <= 250 THEN 8 ELSE 9 END"


@query(f"""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type AS endpoint, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total_cs,
 {', '.join(f'count(*) FILTER ({BINS} = {i}) AS b{i}' for i in range(10))} FROM events GROUP BY 1, 2""")
def stream_hourly_rollup(t: Tables):
    out = run_rollup(t.spark, t.sf_dir, t.events.schema, shared_folder(t.spark, "stream"), "events.parquet")
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(SQL["slot_operations"])
def stream_slot_operations(t):
    """The operations of slot_operations through the state machine with timers: the same results."""
    events = read_events(t.spark, t.sf_dir, t.events.schema, "events.parquet")
    ops = slot_work(events).withColumnRenamed("event_id", "tie").withColumn("time", from_seconds(F.col("at")))
    out = run_slots(t.spark, ops, 50_000, shared_folder(t.spark, "slots"), keep=10**9)
    return out.where("kind <> 'timer'").select(F.col("tie").alias("event_id"), "result")


@query("""
WITH m AS (SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2), h AS (SELECT date_trunc('hour', minute) AS hour, event_type, CAST(sum(n) AS BIGINT) AS n, max(n) AS busiest, count(*) AS minutes FROM m GROUP BY 1, 2)
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, event_type, n, busiest, minutes FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_minutes_to_hours(t):
    """Every hour that is closed ten minutes before the last event, out of its minutes."""
    events = read_events(t.spark, t.sf_dir, t.events.schema, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out, _ = run_hours(events, shared_folder(t.spark, "hours"), "at", "event_type")
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))
