"""Golden values of event analytics on invented rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomery.functions import timeops as to
from loomery.operators import events as ev

LOG = [
    # seq, day, sid, kind
    (1, "d1", "a", "search"), (2, "d1", "a", "open"), (3, "d1", "a", "act"),
    (4, "d1", "b", "act"), (5, "d1", "b", "search"), (6, "d1", "b", "search"), (7, "d1", "b", "yes"),
    (8, "d1", "c", "report"),
    (9, "d2", "a", "act"),
]


def kinds():
    k = F.col("kind")
    return ev.Kinds(search=k == "search", opened=k == "open", action=k == "act", satisfied=k == "yes")


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, "seq long, day string, sid string, kind string")


def test_funnel(log):
    got = {r.day: r for r in ev.funnel(log, kinds()).collect()}
    d1 = got["d1"]
    assert (d1.sessions, d1.searched, d1.opened, d1.acted, d1.satisfied) == (3, 2, 1, 2, 1)
    assert (d1.searches, d1.successful, d1.acted_rate, d1.success_rate) == (3, 2, 100.0, 66.7)
    d2 = got["d2"]
    assert (d2.sessions, d2.acted, d2.searches, d2.success_rate, d2.acted_rate) == (1, 1, 0, None, None)


def test_action_before_any_search_belongs_to_none(log):
    got = {(r.sid, r.search_no): r.successful for r in ev.attribute(log, kinds()).collect()}
    assert got == {("a", 1): True, ("b", 1): False, ("b", 2): True}


def test_empty_log(log):
    assert ev.funnel(log.limit(0), kinds()).count() == 0


def test_sanitise_rejects_unknown_keys_and_wrong_types(spark):
    raw = ['{"type": "a", "n": 3}', '{"type": "a", "n": 3, "x": 1}', '{"type": "a", "n": "many"}', '{"n": 3}', "broken", '{"type": "b"}', '{"type": "a", "n": 99}', None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, p string")
    fine = ev.sanitise(rows, "p", {"type": "string", "n": "int"}, ["type"], {"n": F.col("event.n") < 50})
    assert sorted(r.i for r in fine.collect()) == [0, 5]


def test_daily_cap(spark):
    rows = spark.createDataFrame([(i, "d1" if i < 7 else "d2") for i in range(10)], "seq int, day string")
    got = {r.seq for r in ev.daily_cap(rows, "day", ["seq"], 5).where("accepted").collect()}
    assert got == {0, 1, 2, 3, 4, 7, 8, 9}


NOW = datetime(2026, 11, 4, 12, 30)


@pytest.mark.parametrize(
    ("preset", "start", "end", "bucket"),
    [
        ("today", datetime(2026, 11, 4), NOW, "hour"),
        ("yesterday", datetime(2026, 11, 3), datetime(2026, 11, 4), "hour"),
        ("7d", datetime(2026, 10, 29), NOW, "day"),
        ("week", datetime(2026, 11, 2), NOW, "day"),
        ("prev_month", datetime(2026, 10, 1), datetime(2026, 11, 1), "day"),
        ("year", datetime(2026, 1, 1), NOW, "week"),
    ],
)
def test_periods(preset, start, end, bucket):
    p = to.period(preset, NOW)
    assert (p.start, p.end, p.bucket) == (start, end, bucket)
    assert p.previous.end == start and p.previous.end - p.previous.start == end - start


def test_custom_periods():
    p = to.period("custom", NOW, "2026-10-01", "2026-10-02")
    assert (p.start, p.end) == (datetime(2026, 10, 1), datetime(2026, 10, 3)) and len(p.buckets()) == 48
    assert to.period("custom", NOW, "2026-11-01", "2026-12-31").end == NOW
    for a, b in (("2026-02-30", "2026-03-01"), ("2026-03-02", "2026-03-01"), ("2020-01-01", "2026-01-01"), ("2027-01-01", "2027-01-02")):
        with pytest.raises(ValueError):
            to.period("custom", NOW, a, b)
    assert to.period("custom", NOW, "2025-01-15", "2026-09-01").bucket == "month"


def test_local_day_crosses_midnight(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-05-01 22:30:00' AS ts").select(to.local_day(F.col("ts")).cast("string"), to.local_hour(F.col("ts")), to.local_weekday(F.col("ts"))).first()
    assert tuple(row) == ("2024-05-02", 1, 3)


def test_resolve_days(spark):
    from datetime import date

    days = lambda **k: [str(r.day)[8:] for r in to.resolve_days(spark, date(2026, 11, 4), **k).orderBy("day").collect()]
    assert days(only=["this_week"]) == ["04", "05", "06", "07", "08"]
    assert days(only=["next_week"]) == ["09", "10", "11", "12", "13", "14", "15"]
    assert days(only=["weekend"], not_on=["2026-11-08"]) == ["07", "14", "15"]
    assert days(only=["today", "mon"]) == ["04", "09", "16"]
