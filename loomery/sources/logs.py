"""Day-partitioned event logs: scan, append with a daily cap, summaries of finished days, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeops import local_day
from ..operators.events import within_cap


def read_days(spark: SparkSession, path: str, schema: str | T.StructType, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events of a JSON-lines log partitioned by day; blank and broken lines are dropped, only the asked days are read."""
    asked = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(asked).option("mode", "DROPMALFORMED").json(path).select(*asked.names)
    if first:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return rows


def lines(spark: SparkSession, path: str) -> int:
    """Lines of text files."""
    return spark.read.text(path).count()


def append_days(events: DataFrame, path: str, order: list[str], cap: int, ts: str = "ts", batch: str | None = None) -> DataFrame:
    """Append events to their local day, at most `cap` a day counting those already there.

    Returns (day, accepted, dropped). Times are cut to the minute, as the log keeps no finer ones. Every append leaves a report, a
    row a day, in `_appends` beside the log; what a day holds is the sum of those, so only a log without any is read to count it.

    batch: the append's name. Its events then lie in the folders day=.../batch=... and appending a batch again, with the same
    events, puts them in place of those of the first try, finished or not, so that a repeat never doubles. A log
    is written either with batches or without.
    """
    spark = events.sparkSession
    dated = events.withColumn("day", local_day(F.col(ts)))
    held = _counts(spark, path, batch)
    left = dated.join(held, "day", "left").withColumn("__left", F.greatest(F.lit(cap) - F.coalesce("__held", F.lit(0)), F.lit(0)))
    marked = within_cap(left, "day", order, F.col("__left")).withColumnRenamed("accepted", "__fits")
    told = marked.groupBy("day").agg(F.count_if("__fits").alias("accepted"), F.count_if(~F.col("__fits")).alias("dropped"))
    report = spark.createDataFrame(told.collect(), told.schema)  # a row a day
    kept = marked.where("__fits").drop("__fits", "__held", "__left").withColumn(ts, F.date_trunc("minute", ts))
    if batch is None:
        kept.write.mode("append").partitionBy("day").json(path)
    else:
        named = kept.withColumn("batch", F.lit(batch))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(path)
    report.coalesce(1).write.mode("overwrite").json(f"{path}/_appends/{f'of-{batch}' if batch else uuid.uuid4().hex}")
    return report


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _counts(spark: SparkSession, path: str, batch: str | None) -> DataFrame:
    """(day, __held): accepted events by day, those of `batch` left out; read before the append."""
    if _exists(spark, f"{path}/_appends"):
        reports = spark.read.schema("day date, accepted long").option("recursiveFileLookup", "true").json(f"{path}/_appends")
        if batch:
            reports = reports.where(~F.col("_metadata.file_path").contains(f"/_appends/of-{batch}/"))
        held = reports.groupBy("day").agg(F.sum("accepted").alias("__held"))
    elif _exists(spark, path):
        rows = spark.read.schema("day date").option("mode", "PERMISSIVE").json(path)
        held = (rows.where(F.col("batch") != batch) if batch and "batch" in rows.columns else rows).groupBy("day").agg(F.count(F.lit(1)).alias("__held"))
    else:
        return spark.createDataFrame([], "day date, __held long")
    return spark.createDataFrame(held.collect(), held.schema)  # a row a day


def summaries(events: DataFrame, cached: DataFrame | None, version: int, today: Column, summarise) -> DataFrame:
    """Daily summaries: those cached under this version, and new ones for the other days.

    Days before today are finished; their new summaries may be cached. `summarise` makes a row per day.
    """
    if cached is None:
        return summarise(events).withColumns({"version": F.lit(version), "finished": F.col("day") < today})
    fresh = cached.where((F.col("version") == version) & (F.col("day") < today))
    new = summarise(events.join(fresh.select("day"), "day", "left_anti"))
    return fresh.withColumn("finished", F.lit(True)).unionByName(new.withColumns({"version": F.lit(version), "finished": F.col("day") < today}))
