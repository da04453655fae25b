"""A graph file as a data source: read back whole in any ranges, broken files refused."""

import random
import struct

import pytest

from loomery.operators import graph
from loomery.sources import graphfile as gf


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    nodes = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    edges = [(0 if rng.random() < 0.4 else rng.randrange(5, 60), rng.randrange(60), rng.randrange(5000), rng.choice([0, 30, 60, 110]), rng.randrange(8)) for _ in range(301)]
    return nodes, edges


def load(spark, path, part="edges", rows=7):
    gf.register(spark)
    return spark.read.format("roadgraph").option("part", part).option("rows", rows).load(path)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_read_back(spark, made, tmp_path, rows):
    nodes, edges = made
    path = tmp_path / "g.bin"
    path.write_bytes(gf.encode(nodes, edges))
    df = load(spark, str(path), rows=rows)
    assert df.rdd.getNumPartitions() == -(-len(edges) // rows)
    assert sorted(map(tuple, df.collect())) == sorted(edges)
    back = {r.node: (r.lat, r.lon) for r in load(spark, f"file://{path}", "nodes", rows).collect()}
    assert len(back) == 60 and all(abs(back[i][0] - a) < 1e-6 and abs(back[i][1] - b) < 1e-6 for i, (a, b) in enumerate(nodes))


def test_costs_lead_into_a_search(spark, tmp_path):
    path = tmp_path / "g.bin"
    path.write_bytes(gf.encode([(0, 0)] * 4, [(0, 1, 1000, 36, gf.CAR), (1, 2, 1000, 0, gf.CAR | gf.FOOT), (0, 2, 100, 90, gf.FOOT), (2, 3, 50, 0, gf.BIKE)]))
    costs = gf.edge_costs(load(spark, str(path)), gf.CAR, 18.0)
    start = spark.createDataFrame([(0,)], "source long")
    assert {r.node: r.cost for r in graph.shortest(costs, start).collect()} == {0: 0, 1: 100_000, 2: 300_000}
    walk = gf.edge_costs(load(spark, str(path)), gf.FOOT, 5.0, by_speed=False)
    assert {(r.src, r.dst): r.cost for r in walk.collect()} == {(1, 2): 720_000, (0, 2): 72_000}


def test_empty_graph(spark, tmp_path):
    path = tmp_path / "g.bin"
    path.write_bytes(gf.encode([], []))
    assert load(spark, str(path)).count() == 0 and load(spark, str(path), "nodes").count() == 0


def broken(data, at, value):
    out = bytearray(data)
    struct.pack_into("<I", out, at, value)
    return bytes(out)


def test_broken_files_are_refused(spark, made, tmp_path):
    whole = gf.encode(*made)
    starts = gf.Layout(60, 301).starts
    bad = {
        "short": whole[:40], "magic": broken(whole, 0, 7), "version": broken(whole, 4, 9), "cut": whole[:-8], "claims": broken(whole, 12, 10**6),
        "end": broken(whole, starts["first"] + 4 * 60, 300), "order": broken(whole, starts["first"] + 4 * 20, 299), "target": broken(whole, starts["target"] + 4 * 100, 60),
    }
    for name, data in bad.items():
        path = tmp_path / f"{name}.bin"
        path.write_bytes(data)
        with pytest.raises(Exception, match="graph"):
            load(spark, str(path), rows=1000).collect()
    with pytest.raises(Exception, match="edges and nodes"):
        load(spark, str(tmp_path / "cut.bin"), "roads").collect()
