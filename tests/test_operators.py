"""Operators that SQL cannot state, and edge cases of the others, on small fixtures."""

import heapq
import random
from datetime import date
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from loomery import plans
from loomery.functions import hours as hr
from loomery.functions import text as tx
from loomery.operators import basket, etl, graph, joins, ledger, linking, privacy, schedule, search, telemetry
from loomery.sources import logs, tables
from loomery.streaming import jobs


def test_osa_counts_a_swap_once(spark):
    assert [tx.osa(a, b) for a, b in (("petrov", "petorv"), ("ca", "abc"), ("", "abc"), ("same", "same"), ("kitten", "sitting"))] == [1, 3, 3, 0, 3]
    assert tx.osa("abcdefgh", "zzzzzzzz", 2) == 3
    got = spark.createDataFrame([("petrov", "petorv"), (None, "a")], "a string, b string").select(tx.osa_distance("a", "b")).collect()
    assert [r[0] for r in got] == [1, None]


def one(spark, expr, **columns):
    values = {k: v for k, v in columns.items()}
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (tx.canonical, "ＡＢＣ​ Ёлка-2", "abc ejika 2"[:3]),
        (tx.collapse_repeats, "heeello  x", "helo x"),
        (tx.unfold_leet, "H3LL0 $am", "hello sam"),
        (tx.slug, "Щука & Ко!", "shchuka-ko"),
        (tx.from_layout, "руддщ", "hello"),
        (tx.csv_cell, "=1+1", "'=1+1"),
        (tx.csv_cell, 'a;"b"', '"a;""b"""'),
        (tx.csv_cell, None, ""),
        (tx.address_key, "10.0.0.1", "10.0.0.1"),
        (tx.address_key, "2001:0db8:0:1::5", "2001:db8:0:1::/64"),
        (tx.address_key, "2001:db8::5", "2001:db8:0:0::/64"),
        (tx.metric_name, "calls{a=b}", "calls"),
    ],
)
def test_text_functions(spark, make, text, want):
    got = one(spark, make(F.col("t")), t=F.lit(text).cast("string"))
    assert got == want or make is tx.canonical and got.startswith(want)


@pytest.mark.parametrize("name, swaps", [("osa_join", True), ("levenshtein_words", False)])
def test_one_edit_joins_take_all_words(spark, tmp_path, name, swaps):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé,") for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"a", "ab", "abcdefghijkl", "abcdefghijlk", "acbdefghijkl"}
    near = lambda a, b: a < b and a[0] == b[0] and tx.osa(a, b) <= 1
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.a, r.b) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
    swapped = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) > 1
    assert got == {(a, b) for a in words for b in words if near(a, b) and (swaps or not swapped(a, b))}


def test_cells_of_whole_texts_are_quoted(spark, tmp_path):
    text = "x" * 80 + ' "a", b'
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["csv_escape_whole"](spark, str(tmp_path)).first()
    cell = '"' + text.replace('"', '""') + '"'
    assert (got.digest, got.chars) == (md5(cell.encode()).hexdigest(), len(cell))


def test_metric_keys(spark):
    labels = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, tx.metric_key(F.lit("calls"), labels)) == "calls{a=1,b=2}"
    assert one(spark, tx.metric_labels(F.lit("calls{a=1,b=2}"))) == {"a": "1", "b": "2"}
    assert one(spark, tx.metric_labels(F.lit("calls"))) == {}


def test_endpoints(spark):
    cases = [("get", "/api/users/17", 200, "GET /api/users/:id"), ("POST", "/api/x?y=1", 201, "POST /api/x"), ("get", "/api/x", 404, "unknown"), ("get", "/logo.png", 200, "static"), ("get", "/api/a/b/c/d/e/f/g", 200, "unknown")]
    for verb, path, status, want in cases:
        assert one(spark, tx.endpoint(F.lit(verb), F.lit(path), F.lit(status))) == want


def test_prices(spark):
    cases = [("1 200", (1200, 1200, False)), ("1200-1 500 EUR", (1200, 1500, False)), ("from 900", (900, None, True)), ("ask us", None), ("500-300", None)]
    for text, want in cases:
        got = one(spark, tx.price(F.lit(text)))
        assert (tuple(got) if got else None) == want


def test_negation(spark):
    text = "please not on monday but tuesday"
    assert one(spark, tx.negated(F.lit(text), F.lit(text.index("monday") + 1)))
    assert not one(spark, tx.negated(F.lit(text), F.lit(1)))


def test_opening_hours(spark):
    cases = [("9:00-13:00, 14:00–18:30", [(540, 780), (840, 1110)]), ("22:00-6:00", [(1320, 1800)]), ("24/7", [(0, 1440)]), ("closed", []), (None, None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", hr.intervals(F.col("t")).alias("x")).orderBy("i").collect()
    assert [None if r.x is None else [tuple(x) for x in r.x] for r in rows] == [c[1] for c in cases]
    day = spark.range(1).select(hr.intervals(F.lit("22:00-6:00")).alias("a"), hr.intervals(F.lit("9:00-18:00")).alias("b"), hr.intervals(F.lit(None).cast("string")).alias("n"))
    got = day.select(hr.open_at(F.col("b"), F.col("a"), F.lit(300)), hr.open_at(F.col("b"), F.col("b"), F.lit(300)), hr.open_at(F.col("n"), F.col("n"), F.lit(300)), hr.evening_until(F.col("b")), hr.works_after(F.col("b"), 1080)).first()
    assert tuple(got) == (True, False, None, False, False)


def test_diverse_picks_are_greedy(spark):
    rows = [(1, "p1", "x"), (2, "p1", "y"), (3, "p2", "x"), (4, "p3", "y"), (5, "p4", "x")]
    frame = spark.createDataFrame([("g", *r) for r in rows], "g string, rank int, person string, place string")
    got = [r["rank"] for r in search.diverse_picks(frame, ["g"], "rank", "person", "place").orderBy("pick").collect()]
    assert got == [1, 4, 3]


def test_diverse_picks_look_for_people_in_the_whole_group(spark):
    rows = [(i, "p1", f"x{i}") for i in range(1, 14)] + [(14, "p2", "x1"), (15, "p2", "y"), (16, "p3", "x1"), (17, "p4", "z")]
    frame = spark.createDataFrame([("g", *r) for r in rows], "g string, rank int, person string, place string")
    got = [r["rank"] for r in search.diverse_picks(frame, ["g"], "rank", "person", "place").orderBy("pick").collect()]
    assert got == [1, 14, 16]


def test_funnel_and_relaxations(spark):
    c = spark.range(100)
    stages = {"even": F.col("id") % 2 == 0, "small": F.col("id") < 10, "odd": F.col("id") % 2 == 1, "unknown": F.lit(None).cast("boolean")}
    assert [r.n for r in search.funnel(c, stages).orderBy("step").collect()] == [100, 50, 5, 0, 0]
    assert search.blocking_stage(c, stages).first().stage == "odd"
    two = {k: stages[k] for k in ("even", "small", "odd")}
    assert {r.dropped: r.n for r in search.relaxations(c, two).collect()} == {"even": 5, "small": 0, "odd": 5}
    assert search.relax_in_order(c, two, ["small", "odd"]).first().dropped == "small+odd"
    assert search.relax_in_order(c, {"none": F.lit(False)}, []).first().step is None


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None}
    points = spark.range(50).select(F.col("id").alias("p"))
    ranges = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, 7, 33)], "r int, lo int, hi int")
    pairs = {(r.p, r.r) for r in joins.range_join(points, ranges, "p", "lo", "hi", 8).collect()}
    assert pairs == {(p, r) for p in range(50) for r, lo, hi in ((1, 0, 10), (2, 5, 5), (3, 7, 33)) if lo <= p < hi}


def test_best_rule_ties_go_to_the_first(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string")
    rules = spark.createDataFrame([(2, "x", "second"), (1, "x", "first"), (3, None, "all")], "seq int, r_kind string, access string")
    on = F.col("r_kind").isNull() | (F.col("r_kind") == F.col("kind"))
    got = {r.id: r.access for r in joins.best_rule(facts, rules, on, F.col("r_kind").isNotNull().cast("int"), "seq", ["id"], ["access"]).collect()}
    assert got == {1: "first", 2: "all"}


def test_every_part_counts(spark, tmp_path):
    parts = [(100, "b", 1, "t"), (101, "c", 1, "t"), (102, "c", 1, "u"), (103, "d", 3, "v")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(100,), (100,), (103,), (104,)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {n: sorted(map(tuple, plans.QUERIES[n](spark, str(tmp_path)).collect())) for n in ("panel_overlap_whole", "mapping_reconciliation_whole")}
    assert got == {"panel_overlap_whole": [("b 1", "c 1", 1)], "mapping_reconciliation_whole": [(100, "mapped", 2), (103, "unmapped", 1), (104, "unmapped", 1)]}


def test_quote(spark):
    offers = spark.createDataFrame([("a", "t1", 10), ("a", "t2", 5), ("b", "t1", 7)], "s string, t string, price int")
    wanted = spark.createDataFrame([("t1", "blood"), ("t2", "blood")], "t string, kind string")
    fees = spark.createDataFrame([("a", "blood", 3), ("b", "blood", 1)], "s string, kind string, fee int")
    got = {r.s: (r.missing, r.total) for r in basket.quote(offers, wanted, fees, "s", ["t"], "price", "kind", "fee").collect()}
    assert got == {"a": (0, 18), "b": (1, 8)}


def dijkstra(edges, source):
    out, heap = {}, [(0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in out:
            out[x] = d
            for y, c in edges.get(x, ()):
                heapq.heappush(heap, (d + c, y))
    return out


def test_shortest_paths_match_dijkstra(spark):
    edges = graph.grid_graph(spark, 7).where("access = 7").cache()
    plain = {}
    for r in edges.collect():
        plain.setdefault(r.src, []).append((r.dst, r.cost))
    got = {(r.source, r.node): r.cost for r in graph.shortest(edges, spark.createDataFrame([(0,), (30,)], "source long")).collect()}
    want = {(s, n): d for s in (0, 30) for n, d in dijkstra(plain, s).items()}
    assert got == want
    near = {(r.source, r.node): r.cost for r in graph.shortest(edges, spark.createDataFrame([(0,)], "source long"), ceiling=12).collect()}
    assert near == {k: d for k, d in want.items() if k[0] == 0 and d <= 12}


def test_largest_strong_component(spark):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    edges = ring + [(20, 21), (21, 20), (3, 20), (40, 1)]
    got = {r.node for r in graph.largest_strong_component(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == set(range(9))


def test_largest_strong_component_behind_many_hubs(spark):
    hubs = [(1000 + h, 2000 + 10 * h + i) for h in range(70) for i in range(4)]
    edges = hubs + [(h, 0) for h, _ in hubs] + [(i, (i + 1) % 5) for i in range(5)] + [(0, 50), (50, 51), (51, 50)]
    got = {r.node for r in graph.largest_strong_component(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == set(range(5))


def test_snap_avoids_fast_roads(spark):
    points = spark.createDataFrame([(1, 50.0, 30.0)], "p int, lat double, lon double")
    segments = spark.createDataFrame([(1, 50.0005, 29.999, 50.0005, 30.001, 100), (2, 49.999, 29.999, 49.999, 30.001, 40)], "seg int, lat1 double, lon1 double, lat2 double, lon2 double, speed int")
    got = graph.snap(points, segments, "p").first()
    assert got.seg == 2 and abs(got.share - 0.5) < 1e-6 and 100 < got.metres < 120


def test_ways_to_edges(spark):
    ways = spark.createDataFrame([(1, "road", [1, 2, 3], False, "50 km/h"), (2, "lane", [3, 4], True, None), (3, "road", [9], False, None)], "way int, kind string, nodes array<int>, oneway boolean, maxspeed string")
    got = {(r.src, r.dst, r.speed) for r in graph.ways_to_edges(ways, {"lane": 20}, 30).collect()}
    assert got == {(1, 2, 50), (2, 1, 50), (2, 3, 50), (3, 2, 50), (3, 4, 20)}


def test_resolve_overlaps():
    spans = [("digits", 0, 10, 0.6), ("phone", 0, 12, 0.9), ("url", 20, 30, 0.9), ("email", 25, 29, 0.98)]
    assert privacy.resolve(spans) == [("phone", 0, 12, 0.9), ("url", 20, 30, 0.9)]


def test_tokens_and_substitution(spark):
    text = "mail a@b.org or c@d.org, again a@b.org from 10.0.0.1"
    row = spark.createDataFrame([(text,)], "t string").select("t", privacy.detector()("t").alias("s")).withColumn("n", privacy.tokens(F.col("s")))
    assert row.select(privacy.substitute(F.col("t"), F.col("s"), F.col("n"))).first()[0] == "mail [email_1] or [email_2], again [email_1] from [ipv4_1]"


def test_leaks_by_kind(spark):
    rows = [("phone", "+49 30 1234567", "call 30-123", True), ("phone", "+49 30 1234567", "call 1 2", False), ("email", "a@b.org", "A@B.org!", True), ("card", "1234 5678 9012 3456", "ends 3456", False)]
    got = privacy.leaks(spark.createDataFrame(rows, "kind string, value string, sent string, want boolean"), [], "sent", "kind", "value").collect()
    assert [r.leaked for r in got] == [r.want for r in got]


def test_leaks_of_every_kind_are_reported(spark, tmp_path):
    rows = [(1, "call +49 30 1234567 or 30 12 34 567"), (2, "at 50.12345, 30.12345"), (3, "a@b.org, 1234 5678 9012 3456, https://x.org/y, 1.2.3.4")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.kind: (r.n, r.leaked) for r in plans.QUERIES["leak_check_all"](spark, str(tmp_path)).collect()}
    assert got == {"phone": (1, 1), "coordinates": (1, 1), "email": (1, 0), "card": (1, 0), "url": (1, 0), "ipv4": (1, 0)}


def test_windows_cover_whole_texts(spark):
    texts = ["", "x" * 100, "y" * 3500, "z" * 3501, "w" * 10_000]
    rows = privacy.long_windows(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").collect()
    for i, t in enumerate(texts):
        parts = sorted((r.start, r.window) for r in rows if r.i == i)
        joined = ""
        for start, w in parts:
            assert start <= len(joined) and len(w) <= 3500
            joined = joined[:start] + w
        assert joined == t


def test_phrase_scores(spark):
    for q, n, want in (("iron", "Iron", 0), ("ir", "iron", 1), ("iron", "serum iron", 2), ("ron", "iron", 3), ("zinc", "iron", None)):
        assert one(spark, linking.phrase_score(F.lit(q), F.lit(n))) == want


def test_tables_and_json_ld(spark):
    html = '<table><tr><th>Name</th><th>Price</th></tr><tr><td><b>Scan</b></td><td>head</td><td>1 250</td></tr></table><script type="application/ld+json">{"@graph": [{"name": "A"}, {"name": "B"}]}</script>'
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    rows = etl.table_rows(pages, ["id"], "html")
    assert [tuple(r) for r in etl.price_rows(rows, ["id"]).collect()] == [(1, "Scan", 1250)]
    assert sorted(r.item.name for r in etl.json_ld(pages, ["id"], "html", "struct<name:string>").collect()) == ["A", "B"]
    assert one(spark, etl.html_text(F.lit("<p>a&amp;b<script>x</script><br>c <b>d</b><!-- e --></p>"))) == "a&b\nc d"


def test_triage_measures_from_the_approved_price(spark):
    rows = spark.createDataFrame([("changed", "price", "119", 100.0), ("changed", "price", "121", 100.0), ("added", None, None, 100.0), ("changed", "name", "x", 100.0)], "change string, field string, after string, base double")
    assert [r.decision for r in etl.triage(rows, F.col("base")).collect()] == ["auto", "review", "review", "review"]


def test_rejected_requests_take_no_room(spark):
    rows = spark.createDataFrame([("k", t) for t in (0, 1, 2, 3, 10, 11)], "k string, at long")
    got = [r.accepted for r in ledger.sliding_limit(rows, ["k"], "at", 10, 2).orderBy("at").collect()]
    assert got == [True, True, False, False, True, True]


def test_token_bucket(spark):
    rows = spark.createDataFrame([("k", t, 6.0) for t in (0, 1, 2, 3, 20)], "k string, at long, cost double")
    got = [(r.accepted, r.level) for r in ledger.token_bucket(rows, ["k"], "at", "cost", 10.0, 0.5).orderBy("at").collect()]
    assert got == [(True, 4.0), (True, -1.5), (False, -1.0), (False, -0.5), (True, 2.0)]


def test_lockout_doubles(spark):
    rows = spark.createDataFrame([("k", t, True) for t in (0, 1, 5, 100, 101, 110, 130)], "k string, at long, failed boolean")
    got = [(r.locked, r.until) for r in ledger.lockout(rows, ["k"], "at", "failed", 50, 2, 10, 1000, 10_000).orderBy("at").collect()]
    assert got == [(False, 0), (False, 11), (True, 11), (False, 0), (False, 121), (True, 121), (False, 0)]


def test_slot_operations(spark):
    ops = [(0, "hold", "a", "k1"), (1, "hold", "b", "k2"), (2, "book", "b", "k2"), (3, "book", "a", "k1"), (4, "book", "a", "k1"), (5, "book", "c", "k3"), (6, "cancel", "a", "k1"), (7, "cancel", "a", "k1"), (8, "hold", "b", "k2"), (20, "book", "c", "k3"), (99, "cancel", "c", "k3"), (100, "hold", "d", "k4")]
    rows = spark.createDataFrame([("s", at, kind, who, key, 90) for at, kind, who, key in ops], "slot string, at long, kind string, who string, key string, starts long")
    got = [r.result for r in ledger.apply_slot_operations(rows, "slot", "at", 10).orderBy("at").collect()]
    assert got == ["held", "taken", "taken", "booked", "booked", "taken", "cancelled", "nothing", "held", "booked", "cancelled", "taken"]


def test_prune_keeps_the_newest(spark):
    rows = spark.createDataFrame([("d1", 5), ("d2", 5), ("d3", 50)], "day string, size int")
    assert {r.day for r in ledger.prune(rows, "day", "size", F.lit("d1"), 20).where("kept").collect()} == {"d3"}
    assert {r.day for r in ledger.prune(rows, "day", "size", F.lit("d2"), 60).where("kept").collect()} == {"d2", "d3"}


def test_effective_status(spark):
    rows = spark.createDataFrame([("HELD", 5, 20), ("HELD", 15, 20), ("FREE", 0, 9), ("BOOKED", 0, 5)], "s string, e int, st int")
    got = [r[0] for r in rows.select(schedule.effective_status(F.col("s"), F.col("e"), F.col("st"), F.lit(10))).collect()]
    assert got == ["FREE", "HELD", "PAST", "BOOKED"]


def test_percentiles_of_the_overflow_bin(spark):
    bins = spark.createDataFrame([("a", 0, 1), ("a", 9, 9)], "k string, bin int, n long")
    row = telemetry.histogram_percentiles(bins, ["k"], "bin", "n", [0.1, 0.5]).first()
    assert (row.n, row.p10, row.p50) == (10, 5, 250)


def test_log_caps_count_what_is_there(spark, tmp_path):
    rows = spark.sql("SELECT id AS seq, TIMESTAMP_NTZ'2024-01-01 22:30:45' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(4)")
    path = str(tmp_path / "log")
    assert [(str(r.day), r.accepted, r.dropped) for r in logs.append_days(rows, path, ["seq"], 5).collect()] == [("2024-01-02", 4, 0)]
    assert [(r.accepted, r.dropped) for r in logs.append_days(rows, path, ["seq"], 5).collect()] == [(1, 3)]
    (tmp_path / "log" / "day=2024-01-02" / "broken.json").write_text('{"seq": oops\n')
    got = logs.read_days(spark, path, "seq long, ts string, day date", "2024-01-02", "2024-01-02")
    assert got.count() == 5 and logs.read_days(spark, path, "seq long, ts string, day date", last="2024-01-01").count() == 0


def test_daily_summaries_reuse_finished_days(spark):
    events = spark.createDataFrame([(date(2024, 1, d), 1) for d in (1, 1, 2, 3)], "day date, n int")
    make = lambda e: e.groupBy("day").agg(F.sum("n").alias("n"))
    today = F.lit("2024-01-03").cast("date")
    first = logs.summaries(events, None, 2, today, make)
    stale = first.where("finished").drop("finished").withColumn("n", F.lit(100).cast("long"))
    again = {r.day.day: r.n for r in logs.summaries(events, stale, 2, today, make).collect()}
    assert again == {1: 100, 2: 100, 3: 1}
    assert {r.day.day: r.n for r in logs.summaries(events, stale, 3, today, make).collect()} == {1: 2, 2: 1, 3: 1}


def test_upserts(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    b = spark.createDataFrame([("y", 5), ("z", 7)], "k string, n long")
    assert {tuple(r) for r in tables.add_counters(a, b, ["k"]).collect()} == {("x", 1), ("y", 7), ("z", 7)}
    assert {tuple(r) for r in tables.replace_rows(a, b, ["k"]).collect()} == {("x", 1), ("y", 5), ("z", 7)}


def test_catalog_with_missing_parts(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, name string").write.json(str(tmp_path / "one"))
    spark.createDataFrame([(2, "b")], "id int, place string").write.json(str(tmp_path / "two"))
    got = tables.catalog(spark, [str(tmp_path / "one"), str(tmp_path / "none"), str(tmp_path / "two")])
    assert set(got.columns) == {"id", "name", "place"} and got.count() == 2
    with pytest.raises(FileNotFoundError):
        tables.catalog(spark, [str(tmp_path / "none")])


def test_stream_limit_and_repeats(spark, tmp_path):
    rows = [("k", t) for t in (0, 1, 2, 3, 10, 11)]
    spark.createDataFrame(rows, "k string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at long").parquet(str(tmp_path / "in"))
    out = jobs.sliding_limit(stream, "k", "at", 10, 2)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r.at: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 10: True, 11: True}


def test_rollup_batch_repeats_are_added_once(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts, 'view' AS event_type, 7.0D AS value FROM range(3)")
    sink = jobs.Rollup(str(tmp_path / "t"), ["hour", "endpoint"])
    sink(rows, 0)
    sink(rows, 1)
    sink(rows, 1)
    row = sink.latest(spark).first()
    assert (row.n, row.b1, row.total_cs) == (6, 6, 4200)


def test_shuffled_chain_verifies(spark):
    rows = [("u", i, f"p{i}") for i in range(6)]
    random.Random(1).shuffle(rows)
    chain = ledger.build_chain(spark.createDataFrame(rows, "u string, i int, p string"), "u", "i", "p")
    assert ledger.verify_chain(chain, "u", "i", "p").first().broken == 0
    gap = ledger.verify_chain(chain.where("i <> 3"), "u", "i", "p").first()
    assert gap.broken == 1
