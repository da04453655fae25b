"""Roads and points: suppliers are the nodes of a directed graph, customers the points around it.

Node k has edges to k + 1, 7 k + 3 and 3 k + 5 modulo the number of suppliers; costs are seconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..operators import graph as gr
from .places import KM, POINT, point
from .registry import Tables, query

EDGES = """SELECT src, dst, CAST(60 * (1 + (src * 13 + dst * 7) % 10) AS BIGINT) AS cost, CASE WHEN (src + dst) % 11 = 0 THEN 4 ELSE 7 END AS access FROM (
  SELECT DISTINCT s_suppkey AS src, unnest([(s_suppkey + 1) % n, (s_suppkey * 7 + 3) % n, (s_suppkey * 3 + 5) % n]) AS dst FROM supplier, (SELECT count(*) AS n FROM supplier)) WHERE src <> dst"""


def roads(t: Tables):
    n = t.supplier.agg(F.count(F.lit(1)).alias("n"))
    s = F.col("s_suppkey")
    to = F.array((s + 1) % F.col("n"), (s * 7 + 3) % F.col("n"), (s * 3 + 5) % F.col("n"))
    edges = t.supplier.crossJoin(n).select(s.alias("src"), F.explode(to).alias("dst")).where("src <> dst").distinct()
    return edges.withColumns({"cost": (60 * (1 + (F.col("src") * 13 + F.col("dst") * 7) % 10)).cast("long"), "access": F.when((F.col("src") + F.col("dst")) % 11 == 0, 4).otherwise(7)})


def _search(sources: str, ceiling: int = 10**12) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), d(source, node, cost) USING KEY (source, node) AS (
 SELECT s, s, CAST(0 AS BIGINT) FROM ({sources}) x(s)
 UNION (SELECT d.source, e.dst, min(d.cost + e.cost) FROM d JOIN e ON d.node = e.src LEFT JOIN recurring.d k ON k.source = d.source AND k.node = e.dst
  WHERE d.cost + e.cost <= {ceiling} AND (k.cost IS NULL OR d.cost + e.cost < k.cost) GROUP BY d.source, e.dst))"""


DEPOTS = "SELECT min(s_suppkey) FROM supplier GROUP BY s_nationkey % 4"


def depots(t: Tables):
    return t.supplier.groupBy(F.col("s_nationkey") % 4).agg(F.min("s_suppkey").alias("source")).select("source")


@query(f"{_search(DEPOTS)} SELECT source, node, cost FROM d")
def road_costs(t):
    return gr.shortest(roads(t), depots(t)).select("source", "node", "cost")


@query(f"{_search(DEPOTS, 1800)}, m AS (SELECT source, node, CAST(greatest(floor(cost * 1.9::DOUBLE / 60 + 0.5), 1) AS INTEGER) AS minutes FROM d) SELECT * FROM m WHERE minutes <= 30")
def road_minutes(t):
    """Minutes from every depot after the driving correction, within half an hour."""
    return gr.travel_minutes(gr.shortest(roads(t), depots(t), ceiling=1800), 1.9, 30).select("source", "node", "minutes")


TRIPS = "SELECT s_nationkey AS trip, min(s_suppkey) AS a, max(s_suppkey) AS b, min(s_suppkey) FILTER (s_acctbal > 0) AS c FROM supplier GROUP BY 1"


@query(f"""{_search(f'SELECT a FROM ({TRIPS}) UNION SELECT b FROM ({TRIPS})', 2400)}, t AS ({TRIPS}),
l AS (SELECT trip, a AS source, b AS target FROM t UNION ALL SELECT trip, b, c FROM t WHERE c IS NOT NULL),
g AS (SELECT trip, CAST(sum(d.cost) AS BIGINT) AS cost, bool_or(d.cost IS NULL) AS broken FROM l LEFT JOIN d ON l.source = d.source AND l.target = d.node GROUP BY trip)
SELECT trip, CASE WHEN NOT broken AND cost <= 2400 THEN cost END AS cost, CASE WHEN broken THEN 'unreachable' WHEN cost > 2400 THEN 'too_far' ELSE 'ok' END AS state FROM g""")
def road_trips(t):
    """Trips through two or three stops in order, with a budget for the whole."""
    stops = t.supplier.groupBy(F.col("s_nationkey").alias("trip")).agg(F.array_compact(F.array(F.min("s_suppkey"), F.max("s_suppkey"), F.min(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey"))))).alias("stops"))
    return gr.route(roads(t), stops, 2400).select("trip", "cost", "state")


@query()
def road_paths(t):
    """The nodes on the way of each trip; tests hold every path against its cost, edge by edge."""
    pairs = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("source"), F.max("s_suppkey").alias("target"))
    edges = roads(t)
    return gr.paths(gr.shortest(edges, pairs.select("source").distinct()), pairs)


CUT = f"SELECT src, dst FROM ({EDGES}) WHERE NOT (src % 10 < 4 AND dst % 10 >= 4) AND access = 7"


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({CUT}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
c AS (SELECT x.a AS node, greatest(x.a, max(x.b)) AS top, count(*) AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
k AS (SELECT node, top FROM c), s AS (SELECT top, count(*) AS n FROM k GROUP BY top ORDER BY n DESC, top DESC LIMIT 1) SELECT node FROM k JOIN s USING (top)""")
def road_component(t):
    edges = roads(t).where("NOT (src % 10 < 4 AND dst % 10 >= 4) AND access = 7")
    return gr.largest_strong_component(edges)


SEGMENTS = f"""SELECT a.s_suppkey AS seg, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, 40 + a.s_suppkey % 5 * 15 AS speed FROM
 (SELECT s_suppkey, {POINT.format('s_suppkey')} FROM supplier) a JOIN (SELECT s_suppkey, {POINT.format('s_suppkey')} FROM supplier) b ON b.s_suppkey = a.s_suppkey + 1"""


@query(f"""
WITH s AS ({SEGMENTS}), c AS (SELECT c_custkey, {POINT.format('(c_custkey * 3 + 11)')} FROM customer),
p AS (SELECT c_custkey, seg, speed, (lon2 - lon1) * cos(radians(lat)) * 111194.92664455873 AS dx, (lat2 - lat1) * 111194.92664455873 AS dy, (lon - lon1) * cos(radians(lat)) * 111194.92664455873 AS px, (lat - lat1) * 111194.92664455873 AS py FROM c, s),
q AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0.0), 1.0) ELSE 0.0 END AS share FROM p),
m AS (SELECT *, sqrt(pow(px - share * dx, 2) + pow(py - share * dy, 2)) AS metres FROM q)
SELECT c_custkey, seg, CAST(floor(metres + 0.5) AS BIGINT) AS metres FROM m WHERE metres <= 2000
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY m.metres + CASE WHEN speed >= 80 THEN 150.0 ELSE 0.0 END, seg) = 1""")
def snap_to_roads(t):
    at = t.supplier.select("s_suppkey", *point("s_suppkey"))
    ends = at.select((F.col("s_suppkey") - 1).alias("seg"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    segments = at.select(F.col("s_suppkey").alias("seg"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(ends, "seg").withColumn("speed", 40 + F.col("seg") % 5 * 15)
    customers = t.customer.withColumn("k", F.col("c_custkey") * 3 + 11).select("c_custkey", *point("k"))
    return gr.snap(customers, segments, "c_custkey").select("c_custkey", "seg", F.floor(F.col("metres") + 0.5).cast("long").alias("metres"))


NORTH = "(-89.5 + ({0} * 379 % 1790) / 10.0::DOUBLE) AS lat, (-180.0 + ({0} * 911 % 3600) / 10.0::DOUBLE) AS lon"


def anywhere(key):
    return [(F.lit(-89.5) + key * 379 % 1790 / 10.0).alias("lat"), (F.lit(-180.0) + key * 911 % 3600 / 10.0).alias("lon")]


@query(f"""
WITH c AS (SELECT c_custkey, {NORTH.format('(c_custkey + 5)')} FROM customer), s AS (SELECT s_suppkey, {NORTH.format('s_suppkey')} FROM supplier),
d AS (SELECT c_custkey, s_suppkey, {KM.format('c.lat', 'c.lon', 's.lat', 's.lon')} AS km FROM c, s)
SELECT c_custkey, s_suppkey, CAST(floor(km * 1000 + 0.5) AS BIGINT) AS metres FROM d WHERE km <= 150.0""")
def near_anywhere(t):
    """Points over the whole globe, poles and date line included."""
    c, s = t.customer.select("c_custkey", *anywhere(F.col("c_custkey") + 5)), t.supplier.select("s_suppkey", *anywhere(F.col("s_suppkey")))
    return gr.within(c, s, 150.0).select("c_custkey", F.col("r_s_suppkey").alias("s_suppkey"), F.floor(F.col("km") * 1000 + 0.5).cast("long").alias("metres"))


@query(f"""
WITH p AS (SELECT c_custkey, {POINT.format('c_custkey')} FROM customer), m AS (SELECT degrees(12.5::DOUBLE / 6371.0::DOUBLE) AS d)
SELECT c_custkey FROM p, m WHERE lat BETWEEN 50.2 - d AND 50.6 + d AND lon BETWEEN 30.2 - d / cos(radians(50.4)) AND 30.6 + d / cos(radians(50.4))""")
def coverage_margin(t):
    p = t.customer.select("c_custkey", *point("c_custkey"))
    return p.where(in_box(F.col("lat"), F.col("lon"), 50.2, 30.2, 50.6, 30.6, 12.5)).select("c_custkey")


@query("""
WITH w AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
e AS (SELECT way, node AS src, lead(node) OVER (PARTITION BY way ORDER BY i) AS dst FROM w),
s AS (SELECT way, src, dst, CASE WHEN way % 5 = 0 THEN 50 WHEN o_orderpriority = '1-URGENT' THEN 90 WHEN o_orderpriority = '5-LOW' THEN 20 ELSE 40 END AS speed, o_orderstatus = 'F' AS oneway FROM e JOIN orders ON way = o_orderkey WHERE dst IS NOT NULL)
SELECT way, src, dst, CAST(speed AS INTEGER) AS speed FROM s UNION ALL SELECT way, dst, src, CAST(speed AS INTEGER) FROM s WHERE NOT oneway""")
def edges_of_ways(t):
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("way")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("nodes"))
    ways = nodes.join(t.orders, F.col("way") == F.col("o_orderkey")).select("way", F.col("o_orderpriority").alias("kind"), "nodes", (F.col("o_orderstatus") == "F").alias("oneway"), F.when(F.col("way") % 5 == 0, "50 km/h").alias("maxspeed"))
    return gr.ways_to_edges(ways, {"1-URGENT": 90, "5-LOW": 20}, 40)


@query(f"""{_search('SELECT 0', 3600)}, p AS (SELECT s_suppkey, {POINT.format('s_suppkey')} FROM supplier), n AS (SELECT s_suppkey FROM p ORDER BY {KM.format('lat', 'lon', '50.5', '30.5')}, s_suppkey LIMIT 10)
SELECT s_suppkey, CAST(greatest(floor(cost * 1.0::DOUBLE / 60 + 0.5), 1) AS INTEGER) AS minutes FROM n LEFT JOIN d ON node = s_suppkey""")
def nearest_then_minutes(t):
    """The ten nearest by air, then their minutes by road; null beyond an hour."""
    near = gr.nearest(t.supplier.select("s_suppkey", *point("s_suppkey")), F.lit(50.5), F.lit(30.5), 10, "s_suppkey")
    start = t.supplier.where("s_suppkey = 0").select(F.col("s_suppkey").alias("source"))
    minutes = gr.travel_minutes(gr.shortest(roads(t), start, 3600), 1.0, 60)
    return near.join(minutes, F.col("s_suppkey") == F.col("node"), "left").select("s_suppkey", "minutes")


NATION_PAIRS = "SELECT s.source, s_suppkey AS target FROM supplier JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS source FROM supplier GROUP BY 1) s ON s_nationkey = s.k"


def nation_pairs(t: Tables):
    """From each nation's first supplier to every one of its suppliers."""
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("source"))
    return t.supplier.join(first, "s_nationkey").select("source", F.col("s_suppkey").alias("target"))


@query(f"""{_search(f'SELECT DISTINCT source FROM ({NATION_PAIRS})', 1200)}, p AS ({NATION_PAIRS})
SELECT p.source, p.target, d.cost, CASE WHEN d.cost IS NULL THEN 'unreachable' ELSE 'found' END AS state FROM p LEFT JOIN d ON p.source = d.source AND p.target = d.node""")
def routes_to_goals(t):
    """Routes steered by landmarks towards their targets, up to twenty minutes."""
    edges = roads(t)
    return gr.Goals(edges, gr.landmarks(edges)).search(nation_pairs(t), ceiling=1200)[0]


@query(f"""
WITH c AS (SELECT c_custkey, {NORTH.format('(c_custkey + 5)')} FROM customer), s AS (SELECT s_suppkey, {NORTH.format('s_suppkey')} FROM supplier),
d AS (SELECT c_custkey, s_suppkey, CAST(floor({KM.format('c.lat', 'c.lon', 's.lat', 's.lon')} * 1000 + 0.5) AS BIGINT) AS metres FROM c, s)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY metres, s_suppkey) AS INTEGER) AS rank, s_suppkey, metres FROM d QUALIFY rank <= 3""")
def three_nearest(t):
    """The three nearest suppliers of every customer, anywhere on the globe."""
    c, s = t.customer.select("c_custkey", *anywhere(F.col("c_custkey") + 5)), t.supplier.select("s_suppkey", *anywhere(F.col("s_suppkey")))
    return gr.nearest_of(c, s, "c_custkey", "s_suppkey", 3)
