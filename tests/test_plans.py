"""Every registered query with SQL against DuckDB; the others give rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomery import plans


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, float | np.floating):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, sf, oracle, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    if name not in plans.SQL:
        assert len(got)
        return
    want = oracle.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def norm(frame):  # whole numbers may come as floats where a column holds nulls
        return frame.apply(lambda c: c.astype("Int64") if c.dtype == float and len(c.dropna()) and (c.dropna() % 1 == 0).all() else c)

    assert rows(norm(got)) == rows(norm(want))


def test_streams_read_tables_of_several_files(spark, sf, tmp_path):
    """A table may be a folder of files: none of them is passed over."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_slot_operations", "stream_hourly_rollup"):
        one, many = (plans.QUERIES[name](spark, at).toPandas() for at in (sf, str(tmp_path)))
        assert len(one) and rows(one) == rows(many)
