"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomery", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; any setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
