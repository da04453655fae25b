"""Conditions by the grammar, dialogues with questions that wait, minutes into hours in a stream."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomery.operators import grammar, requests
from loomery.streaming import jobs

NOTHING = {"days": [], "not_days": []} | dict.fromkeys(list(grammar.FIELDS)[2:])


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("on Monday or tuesdays, after 5:30 pm", {"days": ["monday", "tuesday"], "after": 1050}),
        ("not on monday, tuesday or friday but on the weekend", {"not_days": ["monday", "tuesday", "friday"], "days": ["saturday", "sunday"]}),
        ("weekdays except wednesday", {"days": ["monday", "tuesday", "thursday", "friday"], "not_days": ["wednesday"]}),
        ("before 12. No, before 9 am", {"before": 720}), ("before 12. Sorry, until 9 am", {"before": 540}), ("by 17:15 by car", {"before": 1035, "travel_mode": "driving"}),
        ("a woman. Not a woman, a man? A male doctor", {"gender": "male"}), ("no man", {}), ("under 20 minutes on foot, under 3000", {"travel_minutes": 20, "most_price": 3000, "travel_mode": "foot"}),
        ("at least 10 years of practice, over 5", {"experience": 10}), ("show me the 3 nearest", {"limit": 3, "sort": "distance"}), ("5 results, cheapest, not nearest", {"limit": 5, "sort": "price"}), ("repeat visit", {"visit": "repeat"}),
        ("after 25:00 and before 9:75", {}), ("it costs 5000 and takes 7 days", {}), ("don't call on sunday", {"not_days": ["sunday"]}), ("", {}), (None, {}), ("Ünïcode; nothing here, 日本", {}), ("under 99999999999999999999", {}),
    ],
)
def test_conditions(spark, said, want):
    got = spark.createDataFrame([(said,)], "t string").select(grammar.conditions(F.col("t")).alias("c")).first().c.asDict()
    assert got == NOTHING | want


def test_noise_changes_nothing_on_whole_conversations(spark, sf):
    """Clauses that are left out say nothing: the whole token lists give the same."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("t", F.concat("text", F.lit(" by 9. Not on monday, after 3 pm "), "text"))
    every = F.regexp_extract_all(F.lower(F.regexp_replace("t", "['’]", "")), F.lit(grammar.LEXEME), F.lit(0))
    for r in rows.select(every.alias("all"), grammar.conditions(F.col("t")).alias("c")).collect():
        assert tuple(r.c) == grammar.conditions_of(r["all"])


TURNS = "k int, t int, asked string, said string, v string, bare string"


def test_bare_answers_go_to_the_question_that_waits(spark):
    rows = [
        (1, 0, None, None, None, "7"), (1, 1, "day", None, None, None), (1, 2, None, None, None, None), (1, 3, None, None, None, "monday"), (1, 4, None, None, None, "late"),
        (1, 5, "price", None, None, None), (1, 6, "after", None, None, None), (1, 7, None, "price", "90", None), (1, 8, None, None, None, "17"), (1, 9, "day", None, None, None), (1, 10, None, "day", "friday", "x"), (1, 11, None, None, None, "5"),
        (2, 0, None, None, None, "alone"), (None, 0, "day", None, None, None), (None, 1, None, None, None, "sunday"),
    ]
    told = grammar.dialogue(spark.createDataFrame(rows, TURNS).repartition(3), "k", "t", "asked", "said", "v", "bare")
    got = {(r.k, r.t): (r.field, r.value, r.pending) for r in told.collect()}
    assert got[1, 0] == (None, None, None) and got[1, 2] == (None, None, "day") and got[1, 3] == ("day", "monday", None) and got[1, 4] == (None, None, None)
    assert got[1, 6] == (None, None, "after") and got[1, 7] == ("price", "90", "after") and got[1, 8] == ("after", "17", None)
    assert got[1, 10] == ("day", "friday", None) and got[1, 11][0] is None and got[2, 0][0] is None and got[None, 1] == ("day", "sunday", None)
    last = {r.k: (r.day, r.price, r.after) for r in grammar.settled(told, "k", "t", ["day", "price", "after"]).collect()}
    assert last == {1: ("friday", "90", "17"), 2: (None, None, None), None: ("sunday", None, None)}


def test_minutes_into_hours_over_several_files(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(begin + timedelta(seconds=37 * i), "ab"[i % 3 == 0]) for i in range(400)]
    source = str(tmp_path / "in")

    def arrive(part):
        spark.createDataFrame(part, "at timestamp, kind string").coalesce(1).write.mode("append").parquet(source)
        return jobs.run_hours(spark.readStream.schema("at timestamp, kind string").parquet(source), str(tmp_path / "out"), "at", "kind")

    assert arrive(rows[:150])[1] == 0
    arrive(rows[150:])
    out, dropped = arrive([(begin, "a"), (begin + timedelta(hours=9), "a")])
    assert dropped == 1
    minutes = Counter((t.replace(second=0), k) for t, k in rows)
    want = {}
    for (m, k), n in minutes.items():
        was = want.get((m.replace(minute=0), k), (0, 0, 0))
        want[m.replace(minute=0), k] = (was[0] + n, max(was[1], n), was[2] + 1)
    assert {(r.hour, r.kind): (r.n, r.busiest, r.minutes) for r in out.collect()} == want


def test_from_a_text_to_candidates(spark):
    rules = spark.createDataFrame([("tooth*", 3.0, "dentist", 0), ("head*", 3.0, "neuro", 0), ("weak*", 0.5, "general", 0)], "phrase string, weight double, label string, place int")
    flags = spark.createDataFrame([("heart", 1, 1, 1, "chest pain", False)], "flag string, rank int, combo int, part int, phrase string, contextual boolean")
    context = spark.createDataFrame([("last year",)], "phrase string")
    week = ["monday", "tuesday", "friday"]
    rows = [
        (1, "dentist", "female", 300, 5, week, 480, 1080), (2, "dentist", "male", 100, 20, week, 480, 1200), (3, "dentist", None, 50, 30, week, 480, 1200), (4, "dentist", "female", None, 9, week, 480, 1080),
        (5, "dentist", "female", 90, 1, ["sunday"], 600, 900), (6, "neuro", "male", 10, 1, week, 480, 1080),
    ]
    people = spark.createDataFrame(rows, "id int, specialty string, gender string, price long, experience int, days array<string>, opens int, closes int").repartition(3)
    said = {
        "tooth hurts": [3, 2, 4], "tooth, a woman": [4, 1, 5], "toothache, cheapest, show 2": [3, 5], "tooth, under 200; not on sunday": [3, 2], "tooth, on sunday or monday. At least 4 years, after 18:30": [3, 2], "tooth. Only a male, at least 30 years": [],
        "head, before 9": [6], "chest pain and tooth": "emergency", "weak": "unclear", "hello": "unclear", None: "unclear", "tooth, after 5 pm, a man, not on monday, tuesday or friday": [],
    }
    texts = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = {}
    for r in requests.chat_search(texts, ["i"], "t", rules, flags, context, people).orderBy("rank").collect():
        got.setdefault(r.i, [] if r.state in ("found", "nothing") else r.state)
        if r.id is not None:
            assert r.state == "found"
            got[r.i].append(r.id)
    assert got == dict(enumerate(said.values()))


def test_chat_search_reads_conditions_once(spark):
    """Conditions are a table by the time candidates are searched: the plan of the result reads no text again."""
    rules = spark.createDataFrame([("heart", 3.0, "cardio", 0)], "phrase string, weight double, label string, place int")
    flags = spark.createDataFrame([("f", 1, 1, 1, "faint", False)], "flag string, rank int, combo int, part int, phrase string, contextual boolean")
    context = spark.createDataFrame([("was",)], "phrase string")
    people = spark.createDataFrame([(1, "cardio", "female", 50, 9, ["monday"], 480, 1080)], "id int, specialty string, gender string, price int, experience int, days array<string>, opens int, closes int")
    out = requests.chat_search(spark.createDataFrame([(1, "my heart, a woman"), (2, "hello")], "i int, t string"), ["i"], "t", rules, flags, context, people)
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: (r.state, r.id) for r in out.collect()} == {1: ("found", 1), 2: ("unclear", None)}
