"""What the operators of this subpackage share: tables in the shared folder, keys of rows, gapless numbers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word of the contracts: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that with_struct sends back.
BATCH_ROWS = 500
_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session that names none one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomery-", dir=os.environ.get("TMPDIR") or None)
    return _own[app]


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that read the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomery/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that materialise() wrote and nothing will read again."""
    _written.get(spark.sparkContext.applicationId, set()).discard(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete every table that materialise() wrote in this session: once the results that read them are written themselves."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        discard(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What `make` returns as a table; the tables that were written on the way to it are deleted."""
    before = set(_written.get(spark.sparkContext.applicationId, ()))
    out, path = materialise(make())
    for other in _written[spark.sparkContext.applicationId] - before - {path}:
        discard(spark, other)
    return out, path


def own_names(columns: list[str], made: list[str]) -> dict[str, str]:
    """What columns are called beside those that an operator makes: a clashing one gets an underscore, as many as it takes."""
    out: dict[str, str] = {}
    for c in columns:
        name = c
        while name in made or name in out.values():
            name += "_"
        out[c] = name
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Copies that `spread` makes of a row in one task.
PIECE = 20_000


def spread(df: DataFrame, count: str, out: str, deal: list[str]) -> DataFrame:
    """Each row as often as its `count` says, without that column and with the copy's number from 0 as `out`.

    Rows that stand for many are cut into pieces of PIECE copies, dealt out by the piece and the columns `deal`
    before the copies are made, so that no task makes all copies of a row.
    """
    one = df.where(F.col(count) == 1).withColumn(out, F.lit(0).cast("long")).drop(count)
    many = df.where(F.col(count) > 1).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(PIECE).cast("long"))))
    last = F.least(F.col("__at") + PIECE, F.col(count)) - 1
    many = many.repartition(*deal, "__at").withColumn(out, F.explode(F.sequence(F.col("__at"), last)))
    return one.unionByName(many.drop("__at", count))


def gapless(df: DataFrame, group: list[str], order: list, cell: list, out: str, weight: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order (cell, order); a row with a weight takes so many numbers and gets their first.

    `cell` are expressions that cut a group into many parts of bounded size whose own order is the
    order of the numbers. Rows are counted per cell, the counts are summed over the (few) cells, and
    only a cell's rows are sorted together, so no task gets a whole group.
    """
    names = [f"__cell{i}" for i in range(len(cell))]
    df = df.withColumns(dict(zip(names, cell, strict=True)))
    keys = group + names
    counts = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys).orderBy(*order)
    inside = F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(within) - 1
    left, right = df.alias("l"), starts.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.join(right, same).select("l.*", "r.__start")
    return joined.withColumn(out, (F.col("__start") + inside).cast("long")).drop("__start", *names)


def with_struct(df: DataFrame, name: str, fields: T.StructType, fn: Callable[[pa.Array], list], column: str = "text") -> DataFrame:
    """df with a struct column that fn computes from a text column, a batch at a time.

    fn gets an Arrow array and returns one array per field. Other columns pass through untouched, so
    any names and types may stand beside it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields, True)])
    arrow = to_arrow_type(fields)

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), BATCH_ROWS):  # small batches, as whole texts go back to Spark
                batch = whole.slice(i, BATCH_ROWS)
                text = batch.column(batch.schema.get_field_index(column))
                made = [pa.array(x, f.type) for x, f in zip(fn(text), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(made, fields=list(arrow))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
