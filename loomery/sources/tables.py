"""Keyed tables: additive and replacing upserts, retention, catalogs with optional parts, CSV export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell


def add_counters(current: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of both tables added up by key."""
    counters = [c for c in current.columns if c not in keys]
    return current.unionByName(delta.select(*current.columns)).groupBy(*keys).agg(*[F.sum(c).cast(current.schema[c].dataType).alias(c) for c in counters])


def replace_rows(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` in place of those with their keys."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*current.columns))


def retain(rows: DataFrame, day: Column, cutoff: Column) -> DataFrame:
    return rows.where(day >= cutoff)


def catalog(spark: SparkSession, paths: list[str], kind: str = "json") -> DataFrame:
    """Union of catalog files that exist, by column name; missing files and columns are no error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf).exists(where)

    parts = [spark.read.format(kind).load(p) for p in paths if exists(p)]
    if not parts:
        raise FileNotFoundError("none of the catalog files exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fill_from(primary: list[str], suffix: str | None = None) -> Column:
    """The first of several columns that is not blank, without a suffix."""
    value = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in primary])
    return F.regexp_replace(value, rf"\s*{suffix}$", "") if suffix else value


def csv_lines(rows: DataFrame, columns: list[str], delimiter: str = ";") -> DataFrame:
    """(value) lines of a CSV whose cells no spreadsheet runs; write with write.text. The header is `header()`."""
    return rows.select(F.concat_ws(delimiter, *[csv_cell(F.col(c).cast("string")) for c in columns]).alias("value"))


def header(columns: list[str], delimiter: str = ";") -> str:
    return "\ufeff" + delimiter.join(columns)


def edges_of_csr(spark: SparkSession, offsets: str, targets: str) -> DataFrame:
    """(src, dst, ...) from a compressed-row graph kept as tables.

    offsets: node, begin, end; targets: place, dst, ... An interval join by place, on cells of 4096.
    """
    from ..operators.joins import range_join

    nodes = spark.read.parquet(offsets).where("end > begin")
    found = range_join(spark.read.parquet(targets), nodes, "place", "begin", "end", 4096)
    return found.withColumnRenamed("node", "src").drop("begin", "end", "place")
