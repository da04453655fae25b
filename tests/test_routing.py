"""Routes to a goal against plain Dijkstra, the k nearest of many points against brute force, snapping over the date line."""

import heapq
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import graph as gr


def dijkstra(edges, source):
    ahead, cost, heap = {}, {}, [(0, source)]
    for a, b, c in edges:
        ahead.setdefault(a, []).append((b, c))
    while heap:
        d, n = heapq.heappop(heap)
        if n in cost:
            continue
        cost[n] = d
        for b, c in ahead.get(n, []):
            heapq.heappush(heap, (d + c, b))
    return cost


@pytest.fixture(scope="module")
def grid(spark):
    edges = gr.kept(gr.grid_graph(spark, 12))
    return edges, [(r.src, r.dst, r.cost) for r in edges.collect()], gr.landmarks(edges, 4)


PAIRS = [(0, 80), (30, 35), (143, 70), (34, 34), (100, 112), (5, 9999)]


def test_costs_paths_and_rows_relaxed(spark, grid):
    edges, plain, known = grid
    goals = gr.Goals(edges, known)
    pairs = spark.createDataFrame(PAIRS + PAIRS[:1], "source long, target long")
    out, labels = goals.search(pairs)
    got = {(r.source, r.target): (r.cost, r.state) for r in out.collect()}
    want = {p: dijkstra(plain, p[0]).get(p[1]) for p in PAIRS}
    assert got == {p: (c, "unreachable" if c is None else "found") for p, c in want.items()}
    price = {(a, b): c for a, b, c in plain}
    for r in gr.paths(labels, pairs).collect():
        if want[r.source, r.target] is not None:
            assert r.path[0] == r.source and r.path[-1] == r.target
            assert sum(price[s] for s in zip(r.path, r.path[1:])) == want[r.source, r.target]


def test_search_runs_towards_the_goal(spark, grid):
    edges, _, known = grid
    goals = gr.Goals(edges, known)
    near = [(65, 68), (5, 29), (130, 118)]
    goals.search(spark.createDataFrame(near, "source long, target long"))
    everything = gr.shortest(edges, spark.createDataFrame([(p[0],) for p in near], "source long")).count()
    assert goals.relaxed < everything / 5


@pytest.mark.parametrize("wide", [0, 50_000])
def test_costs_from_several_sources(spark, grid, wide, monkeypatch):
    monkeypatch.setattr(gr, "WIDE", wide)
    edges, plain, _ = grid
    got = {(r.source, r.node): r.cost for r in gr.shortest(edges, spark.createDataFrame([(0,), (77,)], "source long"), 30).collect()}
    assert got == {(s, n): c for s in (0, 77) for n, c in dijkstra(plain, s).items() if c <= 30}


def test_ceiling_and_giving_up(spark, grid):
    edges, plain, known = grid
    goals = gr.Goals(edges, known)
    cost = dijkstra(plain, 0)[40]
    pair = spark.createDataFrame([(0, 40)], "source long, target long")
    assert goals.search(pair, ceiling=cost)[0].first()[2:] == (cost, "found")
    assert goals.search(pair, ceiling=cost - 1)[0].first()[2:] == (None, "unreachable")
    assert goals.search(pair, most=2)[0].first().state == "gave_up"


def test_one_way_streets_and_loose_ends(spark):
    plain = [(0, 1, 3), (1, 2, 3), (2, 0, 3), (2, 3, 1), (4, 0, 2), (5, 6, 1), (0, 1, 9), (1, 1, 0)]
    edges = spark.createDataFrame(plain, "src long, dst long, cost long")
    goals = gr.Goals(edges, gr.landmarks(edges, 3))
    pairs = [(a, b) for a in range(8) for b in range(7)]
    got = {(r.source, r.target): r.cost for r in goals.search(spark.createDataFrame(pairs, "source long, target long"))[0].collect()}
    assert got == {(a, b): dijkstra(plain, a).get(b) for a, b in pairs}
    assert goals.search(spark.createDataFrame([], "source long, target long"))[0].count() == 0


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def brute(points, places, k):
    out = []
    for i, *p in points:
        ranked = sorted((math.floor(km(p, q) * 1000 + 0.5), j) for j, *q in places)[:k]
        out += [(i, n + 1, j, m) for n, (m, j) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("first_km", [None, 0.5])
def test_k_nearest_of_many_points(spark, first_km):
    rng = np.random.default_rng(8)
    town = [(i, 50 + float(rng.normal(0, 0.05)), 30 + float(rng.normal(0, 0.05))) for i in range(150)]
    far = [(500, 89.9, 10.0), (501, 89.9, -170.0), (502, -89.5, 0.0), (503, 0.0, 179.99), (504, 0.0, -179.99), (505, 10.0, 10.0), (506, 10.0, 10.0)]
    points = [(i, 50 + float(rng.normal(0, 0.1)), 30 + float(rng.normal(0, 0.1))) for i in range(40)]
    points += [(900, 89.95, 100.0), (901, 0.0, 180.0), (902, -60.0, -120.0), (903, 10.0, 10.0)]
    frame = lambda rows, key: spark.createDataFrame([*rows, (None, None, None)], f"{key} long, lat double, lon double").repartition(3)
    got = gr.nearest_of(frame(points, "p"), frame(town + far, "s"), "p", "s", 3, first_km)
    assert sorted(map(tuple, got.collect())) == brute(points, town + far, 3)


def test_fewer_places_than_asked_for(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 45.0, 90.0)], "p long, lat double, lon double")
    places = spark.createDataFrame([(7, 0.0, 179.0), (8, -45.0, -90.0)], "s long, lat double, lon double")
    assert gr.nearest_of(points, places, "p", "s", 3).count() == 4
    assert gr.nearest_of(points, places.limit(0), "p", "s", 3).count() == 0
    assert gr.nearest_of(points.limit(0), places, "p", "s", 3).count() == 0


def test_snap_over_the_date_line(spark):
    roads = spark.createDataFrame([(1, 60.0, 179.9995, 60.001, 179.9995, 40), (2, 10.0, 179.99, 10.0, -179.99, 40), (3, 0.0, -179.9999, 0.001, -179.9999, 40)], "seg long, lat1 double, lon1 double, lat2 double, lon2 double, speed int")
    points = spark.createDataFrame([(1, 60.0005, -179.9998), (2, 10.0001, 179.9999), (3, 10.0001, -179.995), (4, 0.0005, 179.9999), (5, 10.0, 0.0)], "p long, lat double, lon double")
    got = {r.p: (r.seg, round(r.metres)) for r in gr.snap(points, roads, "p").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 2, 3: 2, 4: 3}
    assert got[1][1] in range(37, 41) and got[2][1] == 11 and got[3][1] == 11 and got[4][1] == 22


def test_tables_of_a_search_can_be_deleted(spark):
    df = gr.kept(spark.range(3).select(F.col("id")))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.isdir(folder)
    gr.release(spark)
    assert not os.path.isdir(folder)


def test_many_points_and_segments_in_one_place(spark):
    """Thirty thousand of each: their pairs, 900 million for every shared cell, are not made."""
    n = 30_000
    lane = spark.range(n).select(F.col("id").alias("seg"), F.lit(50.0).alias("lat1"), F.lit(30.0).alias("lon1"), F.lit(50.0).alias("lat2"), F.lit(30.01).alias("lon2"), F.when(F.col("id") < 7, 90).otherwise(40).alias("speed"))
    points = spark.range(n).select(F.col("id").alias("p"), F.lit(50.001).alias("lat"), F.lit(30.005).alias("lon"))
    began = time.perf_counter()
    got = gr.snap(points, lane, "p").groupBy("seg").agg(F.count("*").alias("n"), F.max("metres").alias("m")).collect()
    assert [(r.seg, r.n) for r in got] == [(7, n)] and abs(got[0].m - 111.19) < 0.01
    assert time.perf_counter() - began < 60
