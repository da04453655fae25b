"""Operators whose cases the query tables do not hold, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import hours, text
from loomery.operators import basket, events, graph, joins, linking, privacy, search


def test_containment_needs_no_whole_word(spark):
    left = spark.createDataFrame([("Ann",), ("dental",), ("x",), ("",), (None,), ("a b",)], "v string")
    right = spark.createDataFrame([("joanna",), ("accidental clinic",), ("zzz",), ("b",)], "w string")
    got = {(r.v, r.w) for r in joins.containment(left, right, "v", "w", ["v"], "w").collect()}
    assert got == {("Ann", "joanna"), ("dental", "accidental clinic"), ("", "accidental clinic"), ("a b", "b")}


def test_contains_pairs_match_plain_search(spark):
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(80)})
    parts = sorted({"".join(rng.choice("abC") for _ in range(rng.randint(0, 5))) for _ in range(60)})
    got = {(r.t, r.p) for r in joins.contains_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(p,) for p in parts], "p string"), "t", "p").collect()}
    assert got == {(t, p) for t in texts for p in parts if p.lower() in t.lower()}


def test_most_specific_rule_equals_the_general_one(spark):
    rng = random.Random(2)
    rules = [(i, rng.choice([None, "a", "b"]), rng.choice([None, "x", "y"]), f"r{i}") for i in range(8)]
    facts = [(i, rng.choice("abc"), rng.choice("xyz")) for i in range(40)]
    r, f = spark.createDataFrame(rules, "seq int, ra string, rb string, v string"), spark.createDataFrame(facts, "id int, a string, b string")
    got = {x.id: x.v for x in joins.most_specific(f, r, {"ra": "a", "rb": "b"}, F.lit(True), "seq", ["id"], ["v"]).collect()}
    for i, a, b in facts:
        fits = [x for x in rules if x[1] in (None, a) and x[2] in (None, b)]
        assert got[i] == (min(fits, key=lambda x: (-((x[1] is not None) + 2 * (x[2] is not None)), x[0]))[3] if fits else None)


def test_near_points_at_high_latitudes_and_over_the_date_line(spark):
    a = spark.createDataFrame([(1, 60.0, 10.0), (2, 89.99, 0.0), (3, 10.0, 179.99)], "p int, lat double, lon double")
    b = spark.createDataFrame([(1, 60.0, 10.12), (2, 89.99, 180.0), (3, 10.0, -179.99), (4, 61.0, 10.0)], "q int, lat double, lon double")
    assert {(r.p, r.r_q) for r in graph.within(a, b, 7.0).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_snap_finds_the_middle_of_long_segments(spark):
    points = spark.createDataFrame([(1, 50.001, 30.25), (2, 50.3, 30.25), (3, 79.999, 10.2)], "p int, lat double, lon double")
    segments = spark.createDataFrame([(1, 50.0, 30.0, 50.0, 30.5, 50), (2, 80.0, 9.0, 80.0, 11.0, 50)], "seg int, lat1 double, lon1 double, lat2 double, lon2 double, speed int")
    got = {r.p: (r.seg, round(r.metres)) for r in graph.snap(points, segments, "p").collect()}
    assert got == {1: (1, 111), 3: (2, 111)}


def test_paths_and_routes(spark):
    edges = graph.grid_graph(spark, 6).where("access = 7")
    cost = {(r.src, r.dst): r.cost for r in edges.collect()}
    costs = graph.kept(graph.shortest(edges, spark.createDataFrame([(0,), (14,)], "source long")))
    least = {(r.source, r.node): r.cost for r in costs.collect()}
    for r in graph.paths(costs, spark.createDataFrame([(0, 35), (14, 0), (0, 0), (0, 99)], "source long, target long")).collect():
        if r.target == 99:
            assert r.cost is None and r.path is None
            continue
        assert r.path[0] == r.source and r.path[-1] == r.target
        assert sum(cost[s] for s in zip(r.path, r.path[1:])) == r.cost == least[r.source, r.target]
    trips = spark.createDataFrame([(1, [0, 14, 35]), (2, [0]), (3, [0, 99]), (4, [0, 35, 0, 35, 0, 35])], "trip int, stops array<long>")
    got = {r.trip: r for r in graph.route(edges, trips, 120).collect()}
    assert [got[i].state for i in (1, 2, 3)] == ["ok", "bad_request", "unreachable"] and got[4].state == "too_far"
    assert sum(cost[s] for s in zip(got[1].path, got[1].path[1:])) == got[1].cost and 14 in got[1].path


def test_caps_match_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abbbb")) for i in range(400)]
    got = {r.i: r.accepted for r in events.daily_cap(spark.createDataFrame(rows, "i int, day string").repartition(5), "day", ["i"], 50).collect()}
    seen = {}
    for i, day in rows:
        seen[day] = seen.get(day, 0) + 1
        assert got[i] == (seen[day] <= 50)
    assert not any(r.accepted for r in events.daily_cap(spark.createDataFrame(rows, "i int, day string"), "day", ["i"], 0).collect())


def test_trigram_pairs_match_all_pairs(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(70)})
    grams = {n: {(" " + n + " ")[i : i + 3] for i in range(len(n))} for n in names}
    df = spark.createDataFrame([(n,) for n in names], "k string")
    for least in (0.3, 0.5, 1.0):
        got = {(r.a, r.b): r.similarity for r in linking.similar_by_trigrams(df, "k", "k", least).collect()}
        want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in names for b in names if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_contained_sets(spark):
    sets = {"a": {1, 2}, "b": {1, 2, 3}, "c": {3}, "d": {1, 2}, "e": {9}}
    got = {(r.name, r.inside) for r in basket.contained(spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], "name string, m int"), "name", "m").collect()}
    assert got == {(x, y) for x in sets for y in sets if x != y and sets[x] <= sets[y]}


def test_masking_with_protected_ranges(spark):
    said = "vitamin D for Ann-Marie Lee, born here"
    ranges = "array<struct<type:string,from:int,to:int>>"
    rows = spark.createDataFrame([(said, [("PERSON", 8, 17), ("PERSON", 14, 23), ("PERSON", 24, 27), ("PLACE", 34, 38)], [(8, 9)])], f"t string, r {ranges}, p array<struct<from:int,to:int>>")
    kept = rows.select("t", privacy.without(F.col("r"), F.col("p")).alias("r"))
    out = kept.select(privacy.labelled(F.col("t"), privacy.joined_ranges(F.col("t"), F.col("r"), ["PLACE", "PERSON"]))).first()[0]
    assert out == "vitamin D[PERSON], born [PLACE]"


def test_reconciled_links_and_detections(spark):
    kind = "array<struct<type:string,from:int,to:int>>"
    rows = spark.createDataFrame([([("name", 0, 10), ("address", 20, 40)], [("doctor", 5, 8), ("clinic", 25, 30), ("city", 50, 55)])], f"d {kind}, l {kind}")
    got = [tuple(r) for r in rows.select(privacy.reconciled(F.col("d"), F.col("l"))).first()[0]]
    assert got == [("doctor", 0, 10), ("address", 20, 40), ("city", 50, 55)]


def test_decoding_is_bounded(spark):
    rows = spark.createDataFrame([("a%2540b",), ("&amp;lt;x&amp;gt;",), ("\\u0041%zz",), ("%ff",), (None,), ("%25252525",)], "t string")
    got = [r[0] for r in rows.select(text.decoded("t")).collect()]
    assert got[:5] == ["a@b", "<x>", "A%zz", "%ff", None] and got[5] == "%25"


def test_highlight_and_one_edit(spark):
    row = spark.createDataFrame([("Anna Banana", ["an", "nan"])], "t string, k array<string>")
    parts = [(p.text, p.match) for p in row.select(text.highlighted(F.col("t"), F.col("k"))).first()[0]]
    assert parts == [("An", True), ("na B", False), ("anan", True), ("a", False)]
    pairs = [("abcd", "abdc", True), ("abcd", "abc", True), ("abcd", "acbd", True), ("abcd", "badc", False), ("abcd", "abcd", True), ("ab", "ba", True)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string, w boolean").select(text.one_edit(F.col("a"), F.col("b"))).collect()]
    assert got == [w for _, _, w in pairs]


@pytest.mark.parametrize(("said", "day", "want"), [("Mo-Fr 08:00-18:00; Sa off", "fr", "08:00-18:00"), ("Fr-Mo 10:00-12:00", "tu", "closed"), ("24/7 || call", "su", "00:00-24:00"), ("Mo 08:70-09:00", "mo", None), ("", "mo", None)])
def test_weeks_of_hours(spark, said, day, want):
    row = spark.createDataFrame([(said,)], "t string").select(hours.week_map(F.col("t")).alias("w")).first()
    assert (row.w[day] if row.w else None) == want


def test_plans_reuse_nothing(spark):
    steps = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, "a")], "plan int, step int, kind string")
    found = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("b", 10, 1.0)], "kind string, id int, cost double")
    got = {(r.plan, r.step): r.id for r in search.without_reuse(steps, found, "plan", "step", ["kind"], "id", ["cost"]).collect()}
    assert got == {(1, 1): 10, (1, 2): 20, (1, 3): None, (1, 4): None, (2, 1): 10}


def test_tokens_run_out_and_stay_in_their_session(spark):
    uses = spark.createDataFrame([(s, k, i, i * 10, f"v{i}") for i, (s, k) in enumerate([("s1", "doctor"), ("s1", "doctor"), ("s2", "doctor"), ("s1", "phone")])], "session string, kind string, i int, at int, value string")
    minted = privacy.mint_tokens(uses, "session", "kind", "i", "at", "secret").cache()
    rows = {r.i: r for r in minted.collect()}
    assert rows[0].token != rows[1].token and rows[0].session_key == rows[1].session_key != rows[2].session_key
    asked = [(rows[0].session_key, rows[0].token, 100), (rows[0].session_key, rows[0].token, 120), (rows[2].session_key, rows[1].token, 20)]
    got = [r.value for r in privacy.redeem(minted, spark.createDataFrame(asked, "session_key string, token string, at int"), "value").orderBy("at").collect()]
    assert got == [None, "v0", None] and privacy.mint_tokens(uses, "session", "kind", "i", "at", "secret", most=2).count() == 3


def test_patterns_of_every_kind(spark):
    said = {
        "iban": "to DE44 5001 0517 5407 3249 please", "social_number": "it is 078-05-1120.", "passport": "C1234567", "document": "passport number: X12-9981", "account": "account no 1234567",
        "internal_id": "see TICK-4411", "plate": "car B-MX 4021", "mac": "at 00:1B:44:11:3A:B7", "ipv6": "2001:0db8:0000:0000:0000:ff00:0042:8329", "secret": "sk_abcdefghijklmnop1234",
        "email_spoken": "jo [at] example [dot] org", "phone_local": "(030) 1234 5678", "phone_dotted": "555.123.4567", "date_dotted": "on 3.12.1999", "date_slashed": "12/24/2001", "date_named": "4 July 1976",
        "born": "born on 1980-02-03", "geo_link": "geo:52.5,13.4", "degrees": "52°31'N 13°24'E", "street": "12 Baker Street", "post_box": "PO Box 12", "post_code": "90210-1234",
    }
    rows = spark.createDataFrame([(k, v) for k, v in said.items()], "want string, t string")
    got = {(r.want, r.kind) for r in privacy.values(rows, ["want"], "t").collect()}
    assert {(k, k) for k in said} <= got and privacy.values(spark.createDataFrame([("plain words, and 12 of them",)], "t string"), [], "t").count() == 0
