"""Appends to a day-partitioned log: reports in place of counting, repeated and broken batches."""

import os
import shutil

import pytest

from loomery.sources import logs

SCHEMA = "seq long, ts string, day date"


def events(spark, first, n):
    return spark.sql(f"SELECT id AS seq, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts FROM range({first}, {first + n})")


def held(spark, path):
    return sorted(r.seq for r in logs.read_days(spark, path, SCHEMA).collect())


def told(report):
    return [(r.accepted, r.dropped) for r in report.collect()]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert told(logs.append_days(events(spark, 0, 4), path, ["seq"], 6, batch="a")) == [(4, 0)]
    assert told(logs.append_days(events(spark, 0, 4), path, ["seq"], 6, batch="a")) == [(4, 0)]
    assert told(logs.append_days(events(spark, 10, 4), path, ["seq"], 6, batch="b")) == [(2, 2)]
    assert told(logs.append_days(events(spark, 0, 4), path, ["seq"], 6, batch="a")) == [(4, 0)]
    assert held(spark, path) == [0, 1, 2, 3, 10, 11]


def test_a_batch_broken_before_its_report(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_days(events(spark, 0, 4), path, ["seq"], 6, batch="a")
    shutil.rmtree(f"{path}/_appends")  # as if the driver had gone between the events and the report
    assert told(logs.append_days(events(spark, 0, 4), path, ["seq"], 6, batch="a")) == [(4, 0)]
    assert held(spark, path) == [0, 1, 2, 3]


@pytest.mark.parametrize("batch", [None, "x"])
def test_counts_come_from_reports(spark, tmp_path, batch):
    path = str(tmp_path / "log")
    logs.append_days(events(spark, 0, 4), path, ["seq"], 5, batch=batch)
    for folder, _, files in os.walk(path):  # the events go, what the day holds is known all the same
        for f in files:
            if "day=" in folder:
                os.remove(os.path.join(folder, f))
    assert told(logs.append_days(events(spark, 4, 4), path, ["seq"], 5, batch=batch and "y")) == [(1, 3)]


def test_more_than_the_cap_is_there(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_days(events(spark, 0, 4), path, ["seq"], 9)
    assert told(logs.append_days(events(spark, 4, 3), path, ["seq"], 2)) == [(0, 3)]
