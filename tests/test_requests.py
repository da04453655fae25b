"""Requests, conditions said in texts, calendar readings."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loomery.operators import requests as rq


def test_requests_are_closed():
    made, errors = rq.Request.read({"cities": [1, 2], "not_cities": [2], "limit": 500, "sort": "odd", "colour": "red"})
    assert made.cities == (1, 2) and made.limit == 5 and made.sort == "recommendation" and len(errors) == 4
    assert rq.Request.read({})[1] == []


def test_unknown_city_fails_both_lists(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, city int")
    for raw, want in (({"cities": [1]}, [1]), ({"not_cities": [1]}, [2])):
        best, funnel, relaxed = rq.find(rows, rq.Request.read(raw)[0], [F.col("id")])
        assert [r.id for r in best.collect()] == want
        assert [r.n for r in funnel.orderBy("step").collect()] == [3, 1]
        assert [r.n for r in relaxed.collect()] == [3]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Monday or Tuesday after 5 pm, not on Tuesday", {"days": ["monday"], "not_days": ["tuesday"], "after": 1020}),
        ("before 12:30 and under 1 500", {"before": 750, "most_price": 1500}),
        ("a female doctor with at least 10 years, no male", {"gender": "female", "experience": 10}),
        ("from 9 am until 11 am on weekdays", {"after": 540, "before": 660, "days": ["weekdays"]}),
        ("nothing here", {}),
    ],
)
def test_conditions(text, want):
    empty = {"days": [], "not_days": [], "after": None, "before": None, "most_price": None, "gender": None, "experience": None}
    assert rq.conditions_of(text) == empty | want


def test_calendar_readings(spark):
    rows = spark.createDataFrame([(date(2026, 1, 20), 15), (date(2026, 1, 10), 31), (date(2026, 1, 31), 30)], "d date, n int")
    assert [str(r[0]) for r in rows.select(rq.day_of_month(F.col("d"), F.col("n"))).collect()] == ["2026-02-15", "2026-01-31", "2026-03-30"]
    got = spark.range(1).select(rq.windows_of(F.lit(9), F.lit(6)).alias("a"), rq.windows_of(F.lit(3), F.lit(10)).alias("b"), rq.round_up(F.lit(61)).alias("r")).first()
    assert [tuple(x) for x in got.a] == [(540, 1080)] and [tuple(x) for x in got.b] == [(900, 1320)] and got.r == 65


def test_turns_fold_to_the_last_value(spark):
    rows = spark.createDataFrame([("c", 1, 5, "x"), ("c", 2, None, "y"), ("c", 3, 7, None)], "k string, t int, a int, b string")
    assert tuple(rq.fold_turns(rows, "k", "t", ["a", "b"]).first()) == ("c", 7, "y")
