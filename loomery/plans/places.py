"""Baskets, rules, schedules, points and graphs.

Stand-ins: a branch is a supplier, a test is a (p_type, p_size), its kind is p_size modulo 4. Points
and opening hours are arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_km, straight_minutes
from ..functions.hours import evening_after, evening_until, intervals, open_at
from ..operators import basket as bk
from ..operators import graph as gr
from ..operators import joins as jn
from ..operators import schedule as sc
from .catalog import CARDS, cards
from .registry import Tables, query

TESTS = f"SELECT s, kind, size, CAST(min(price) AS BIGINT) AS price, CAST(max(n) AS BIGINT) AS turnaround FROM ({CARDS}) GROUP BY ALL"
BASKET = "SELECT * FROM (VALUES ('PROMO', 10, 2), ('ECONOMY', 10, 2), ('STANDARD', 9, 1)) v(kind, size, fee_kind)"
FEES = "SELECT s_suppkey AS s, k AS fee_kind, CAST(100 * (s_suppkey % 7) + k AS BIGINT) AS fee FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE (s_suppkey + k) % 5 <> 0"


def tests(t: Tables):
    return cards(t).groupBy("s", "kind", "size").agg(F.min("price").alias("price"), F.max("n").alias("turnaround"))


def basket(t: Tables):
    return t.spark.createDataFrame([("PROMO", 10, 2), ("ECONOMY", 10, 2), ("STANDARD", 9, 1)], "kind string, size int, fee_kind int")


def fees(t: Tables):
    rows = t.supplier.select(F.col("s_suppkey").alias("s"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("fee_kind"))
    # a fifth of the fees is not known
    return rows.withColumn("fee", (100 * (F.col("s") % 7) + F.col("fee_kind")).cast("long")).where((F.col("s") + F.col("fee_kind")) % 5 != 0)


QUOTE = f"""
WITH o AS ({TESTS}), b AS ({BASKET}), f AS ({FEES}), m AS (SELECT o.*, b.fee_kind FROM o JOIN b USING (kind, size)),
i AS (SELECT s, count(*) AS n_found, CAST(sum(price) AS BIGINT) AS items, max(turnaround) AS slowest FROM m GROUP BY s),
k AS (SELECT d.s, CAST(coalesce(sum(fee), 0) AS BIGINT) AS fees, count(*) FILTER (fee IS NULL) AS no_fee FROM (SELECT DISTINCT s, fee_kind FROM m) d LEFT JOIN f ON d.s = f.s AND d.fee_kind = f.fee_kind GROUP BY d.s),
q AS (SELECT i.s, n_found, items, slowest, fees, 3 - n_found + no_fee AS missing, items + fees AS total FROM i JOIN k ON i.s = k.s)"""


def quotes(t: Tables):
    return bk.quote(tests(t), basket(t), fees(t), "s", ["kind", "size"], "price", "fee_kind", "fee", [F.max("turnaround").alias("slowest")])


@query(f"WITH o AS ({TESTS}), b AS ({BASKET}) SELECT s, count(*) AS n_found, CAST(3 AS BIGINT) AS n_wanted, count(*) = 3 AS complete FROM o JOIN b USING (kind, size) GROUP BY s")
def relational_division(t):
    return jn.division(tests(t), basket(t), "s", ["kind", "size"])


@query(f"""{QUOTE} SELECT *, missing = 0 AND row_number() OVER (PARTITION BY missing = 0 ORDER BY total, s) = 1 AS cheapest,
 missing = 0 AND row_number() OVER (PARTITION BY missing = 0 ORDER BY slowest, s) = 1 AS fastest FROM q""")
def basket_quote(t):
    return bk.badges(quotes(t), "total", "slowest", "s")


@query(f"{QUOTE} SELECT missing, count(*) AS branches, min(total) AS lowest FROM q WHERE missing > 0 GROUP BY missing")
def basket_partial(t):
    return quotes(t).where("missing > 0").groupBy("missing").agg(F.count(F.lit(1)).alias("branches"), F.min("total").alias("lowest"))


@query("""
WITH r AS (SELECT DISTINCT p_brand || ' ' || (p_size % 10) AS name, p_name AS member FROM part), n AS (SELECT name, count(*) AS n FROM r GROUP BY name),
p AS (SELECT a.name, b.name AS inside, count(*) AS n FROM r a JOIN r b ON a.member = b.member AND a.name <> b.name GROUP BY 1, 2)
SELECT p.name, p.inside, p.n FROM p JOIN n ON p.name = n.name AND p.n = n.n""")
def panel_overlap(t):
    return bk.contained(t.part.select(F.concat_ws(" ", "p_brand", (F.col("p_size") % 10).cast("string")).alias("name"), F.col("p_name").alias("member")), "name", "member")


@query("""
WITH r AS (SELECT DISTINCT p_brand || ' ' || p_size AS name, p_type AS member FROM part), n AS (SELECT name, count(*) AS n FROM r GROUP BY name),
p AS (SELECT a.name, b.name AS inside, count(*) AS n FROM r a JOIN r b ON a.member = b.member AND a.name <> b.name GROUP BY 1, 2)
SELECT p.name, p.inside, p.n FROM p JOIN n ON p.name = n.name AND p.n = n.n""")
def panel_overlap_whole(t):
    """Types of each brand and size."""
    return bk.contained(t.part.select(F.concat_ws(" ", "p_brand", "p_size").alias("name"), F.col("p_type").alias("member")), "name", "member")


@query(f"SELECT kind, size, min(price) AS lowest, max(price) AS highest, count(DISTINCT s) AS branches FROM ({TESTS}) GROUP BY kind, size")
def offer_statistics(t):
    return bk.offer_statistics(tests(t), ["kind", "size"], "s", "price")


RULES = [(1, None, None, "none", "1990-01-01", "2030-01-01"), (2, "PROMO", None, "preferred", "1990-01-01", "1999-12-31"), (3, "PROMO", None, "required", "1998-01-01", "2030-01-01"), (4, None, "Brand#5", "direct", "1990-01-01", "2030-01-01"), (5, "ECONOMY", "Brand#7", "referral", "1990-01-01", "2030-01-01"), (6, "ECONOMY", "Brand#7", "none", "1990-01-01", "2030-01-01")]
RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, {repr(r[1]) if r[1] else 'NULL'}, {repr(r[2]) if r[2] else 'NULL'}, '{r[3]}', DATE '{r[4]}', DATE '{r[5]}')" for r in RULES) + ") v(rule_seq, r_kind, r_brand, access, valid_from, valid_to)"


@query(f"""
WITH r AS ({RULES_SQL}), m AS (SELECT p_partkey, access, rule_seq, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN r_brand IS NOT NULL THEN 2 WHEN r_kind IS NOT NULL THEN 1 ELSE 0 END DESC, rule_seq NULLS LAST) AS n
 FROM part LEFT JOIN r ON (r_kind IS NULL OR r_kind = p_type) AND (r_brand IS NULL OR r_brand = p_brand) AND DATE '1998-06-01' BETWEEN valid_from AND valid_to)
SELECT p_partkey, access, CAST(rule_seq AS INTEGER) AS rule_seq FROM m WHERE n = 1""")
def best_rule_join(t):
    rules = t.spark.createDataFrame(RULES, "rule_seq int, r_kind string, r_brand string, access string, valid_from string, valid_to string")
    rules = rules.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    valid = F.lit("1998-06-01").cast("date").between(F.col("valid_from"), F.col("valid_to"))
    return jn.most_specific(t.part.select("p_partkey", "p_type", "p_brand"), rules, {"r_kind": "p_type", "r_brand": "p_brand"}, valid, "rule_seq", ["p_partkey"], ["access", "rule_seq"]).select("p_partkey", "access", "rule_seq")


@query("""
SELECT 'lineitem.part' AS error, CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT l_partkey + 3 AS v FROM lineitem) WHERE v NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders.customer', CAST(v AS VARCHAR) FROM (SELECT DISTINCT o_custkey * 2 AS v FROM orders) WHERE v NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'part.size', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size NOT BETWEEN 2 AND 49""")
def data_quality_errors(t):
    a = jn.missing_references(t.lineitem.select((F.col("l_partkey") + 3).alias("v")), "v", t.part, "p_partkey", "lineitem.part")
    b = jn.missing_references(t.orders.select((F.col("o_custkey") * 2).alias("v")), "v", t.customer, "c_custkey", "orders.customer")
    c = t.part.where(~F.col("p_size").between(2, 49)).select(F.lit("part.size").alias("error"), F.col("p_partkey").cast("string").alias("value"))
    return a.union(b).union(c)


def hours(t: Tables):
    """Hours as texts, arithmetic on the key: one or two intervals, nights, 24/7, unknown."""
    s = F.col("s_suppkey")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    plain = F.concat(pad(7 + s % 4), F.lit(":00-"), pad(16 + s % 6), F.lit(":30"))
    text = F.when(s % 11 == 0, F.lit(None)).when(s % 7 == 0, "24/7").when(s % 5 == 0, F.concat(F.lit("20:00-"), pad(2 + s % 4), F.lit(":00"))).when(s % 3 == 0, F.concat(plain, F.lit(", 22:00-23:00"))).otherwise(plain)
    return t.supplier.select("s_suppkey", text.alias("hours"))


HOURS = """SELECT s_suppkey AS s, unnest(CASE WHEN s_suppkey % 11 = 0 THEN [] WHEN s_suppkey % 7 = 0 THEN [[0, 1440]] WHEN s_suppkey % 5 = 0 THEN [[1200, (2 + s_suppkey % 4) * 60 + 1440]]
 WHEN s_suppkey % 3 = 0 THEN [[(7 + s_suppkey % 4) * 60, (16 + s_suppkey % 6) * 60 + 30], [1320, 1380]] ELSE [[(7 + s_suppkey % 4) * 60, (16 + s_suppkey % 6) * 60 + 30]] END) AS x FROM supplier"""


@query(f"SELECT s AS s_suppkey, CAST(x[1] AS INTEGER) AS opens, CAST(x[2] AS INTEGER) AS closes FROM ({HOURS})")
def opening_intervals(t):
    return hours(t).select("s_suppkey", F.explode(intervals(F.col("hours"))).alias("x")).select("s_suppkey", F.col("x.from").alias("opens"), F.col("x.to").alias("closes"))


@query(f"""
WITH h AS ({HOURS}), a AS (SELECT s_suppkey AS s, s_suppkey % 11 = 0 AS unknown FROM supplier), m AS (SELECT unnest([60, 600, 1050, 1350]) AS minute)
SELECT a.s AS s_suppkey, CAST(m.minute AS INTEGER) AS minute, CASE WHEN NOT unknown THEN EXISTS (SELECT 1 FROM h WHERE h.s = a.s AND ((x[1] <= minute AND minute < x[2]) OR (x[1] <= minute + 1440 AND minute + 1440 < x[2]))) END AS open,
 CASE WHEN NOT unknown THEN EXISTS (SELECT 1 FROM h WHERE h.s = a.s AND x[2] >= 1200) END AS evening_until, CASE WHEN NOT unknown THEN EXISTS (SELECT 1 FROM h WHERE h.s = a.s AND x[2] > 1080) END AS evening_after
FROM a, m""")
def open_now(t):
    known = hours(t).select("s_suppkey", intervals(F.col("hours")).alias("x"))
    rows = known.select("s_suppkey", "x", F.explode(F.array(*[F.lit(m) for m in (60, 600, 1050, 1350)])).alias("minute"))
    return rows.select("s_suppkey", "minute", open_at(F.col("x"), F.col("x"), F.col("minute")).alias("open"), evening_until(F.col("x")).alias("evening_until"), evening_after(F.col("x")).alias("evening_after"))


SLOTS = f"""SELECT s AS s_suppkey, CAST(d AS INTEGER) AS day, CAST(st AS INTEGER) AS start, CAST(st + 30 AS INTEGER) AS "end" FROM
 (SELECT s, x, d, unnest(generate_series(x[1], x[2] - 30, 30)) AS st FROM ({HOURS}), (SELECT unnest(generate_series(0, 13)) AS d)) WHERE (s * 31 + d * 17 + st) % 5 <> 0"""


def slots(t: Tables):
    days = t.spark.range(14).select(F.col("id").cast("int").alias("day"))
    keep = (F.col("s_suppkey") * 31 + F.col("day") * 17 + F.col("start")) % 5 != 0
    return sc.generate_slots(hours(t), days, intervals(F.col("hours")), 30, keep).select("s_suppkey", "day", "start", "end")


@query(SLOTS)
def slot_generate(t):
    return slots(t)


@query(f"""
WITH s AS (SELECT *, CASE WHEN (s_suppkey + day + start) % 4 = 0 THEN 'BOOKED' WHEN (s_suppkey + day + start) % 3 = 0 THEN 'HELD' ELSE 'FREE' END AS status, start + day * 1440 AS m FROM ({SLOTS})),
e AS (SELECT *, CASE WHEN (status = 'FREE' OR (status = 'HELD' AND m % 100 <= 50)) AND m > 2000 THEN true ELSE false END AS free FROM s)
SELECT s_suppkey, count(*) AS n_free, min(m) AS first_at FROM e WHERE free GROUP BY s_suppkey""")
def slot_availability(t):
    s = slots(t)
    mix = F.col("s_suppkey") + F.col("day") + F.col("start")
    at = F.col("start") + F.col("day") * 1440
    s = s.withColumns({"status": F.when(mix % 4 == 0, "BOOKED").when(mix % 3 == 0, "HELD").otherwise("FREE"), "at": at})
    state = sc.effective_status(F.col("status"), F.col("at") % 100 - 50, F.col("at") - 2000, F.lit(0))
    found = sc.first_free(s, ["s_suppkey"], state == "FREE", ["at"], 1)
    return found.select("s_suppkey", "n_free", F.col("first")[0]["at"].alias("first_at"))


POINT = "(50.0 + ({0} * 37 % 1000) / 1000.0::DOUBLE) AS lat, (30.0 + ({0} * 91 % 1000) / 1000.0::DOUBLE) AS lon"
KM = "12742.0::DOUBLE * asin(sqrt(least(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2), 1.0)))"


def point(key: str):
    return [(F.lit(50.0) + F.col(key) * 37 % 1000 / 1000.0).alias("lat"), (F.lit(30.0) + F.col(key) * 91 % 1000 / 1000.0).alias("lon")]


@query(f"""
WITH p AS (SELECT s_suppkey, {POINT.format('s_suppkey')} FROM supplier), d AS (SELECT s_suppkey, {KM.format('lat', 'lon', '50.5', '30.5')} AS km FROM p)
SELECT s_suppkey, CAST(floor(km * 1000 + 0.5) AS BIGINT) AS metres, CAST(greatest(floor(km * (1.3 * 60 / 28.0) + 0.5), 1) AS INTEGER) AS minutes FROM d ORDER BY km, s_suppkey LIMIT 10""")
def haversine_knn(t):
    near = gr.nearest(t.supplier.select("s_suppkey", *point("s_suppkey")), F.lit(50.5), F.lit(30.5), 10, "s_suppkey")
    return near.select("s_suppkey", F.floor(F.col("km") * 1000 + 0.5).cast("long").alias("metres"), straight_minutes(F.col("km"), "drive").alias("minutes"))


@query(f"""
WITH c AS (SELECT c_custkey, {POINT.format('(c_custkey + 5)')} FROM customer), s AS (SELECT s_suppkey, {POINT.format('s_suppkey')} FROM supplier)
SELECT c_custkey, s_suppkey, CAST(floor({KM.format('c.lat', 'c.lon', 's.lat', 's.lon')} * 1000 + 0.5) AS BIGINT) AS metres FROM c JOIN s ON abs(c.lat - s.lat) < 0.06 AND abs(c.lon - s.lon) < 0.06 WHERE {KM.format('c.lat', 'c.lon', 's.lat', 's.lon')} <= 3.0""")
def grid_bin_join(t):
    c = t.customer.withColumn("k", F.col("c_custkey") + 5).select("c_custkey", *point("k"))
    s = t.supplier.select("s_suppkey", *point("s_suppkey"))
    return gr.within(c, s, 3.0).select("c_custkey", F.col("r_s_suppkey").alias("s_suppkey"), F.floor(F.col("km") * 1000 + 0.5).cast("long").alias("metres"))


@query(f"""
WITH p AS (SELECT s_suppkey, {POINT.format('s_suppkey')} FROM supplier) SELECT s_suppkey, CAST(floor({KM.format('lat', 'lon', '50.25', '30.25')} * 1000 + 0.5) AS BIGINT) AS metres FROM p WHERE lat BETWEEN 50.1 AND 50.4 AND lon BETWEEN 30.1 AND 30.4""")
def bbox_filter(t):
    p = t.supplier.select("s_suppkey", *point("s_suppkey")).where(F.col("lat").between(50.1, 50.4) & F.col("lon").between(30.1, 30.4))
    return p.select("s_suppkey", F.floor(haversine_km(F.col("lat"), F.col("lon"), F.lit(50.25), F.lit(30.25)) * 1000 + 0.5).cast("long").alias("metres"))


_CELLS = "SELECT s_suppkey AS i, n, CAST(ceil(sqrt(n)) AS BIGINT) AS w FROM supplier, (SELECT count(*) AS n FROM supplier)"


def _grid(cost: str = "1 + (src * 7 + dst * 13) % 10") -> str:
    """Suppliers as the cells of a square, row by row, each joined with its neighbours."""
    return f"""SELECT src, dst, CAST({cost} AS BIGINT) AS cost, CASE WHEN (src + dst) % 11 = 0 THEN 4 ELSE 7 END AS access FROM (
 SELECT i AS src, (i // w + d.y) * w + i % w + d.x AS dst, n FROM ({_CELLS}), (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(x, y) WHERE i % w + d.x BETWEEN 0 AND w - 1 AND i // w + d.y >= 0) WHERE dst < n"""


def grid(t: Tables):
    n = t.supplier.agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("w"))
    step = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    cells = t.supplier.select(F.col("s_suppkey").alias("src")).crossJoin(n).withColumn("d", F.explode(step))
    x, y = F.col("src") % F.col("w") + F.col("d.x"), F.floor(F.col("src") / F.col("w")) + F.col("d.y")
    moved = cells.where(x.between(0, F.col("w") - 1) & (y >= 0)).withColumn("dst", (y * F.col("w") + x).cast("long")).where("dst < n")
    return moved.select("src", "dst", (1 + (F.col("src") * 7 + F.col("dst") * 13) % 10).cast("long").alias("cost"), F.when((F.col("src") + F.col("dst")) % 11 == 0, 4).otherwise(7).alias("access"))


def _grid_search(cost: str, sources: str, ceiling: int) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED ({_grid(cost)}), d(source, node, cost) USING KEY (source, node) AS (SELECT CAST(s AS BIGINT), CAST(s AS BIGINT), CAST(0 AS BIGINT) FROM ({sources}) x(s)
 UNION (SELECT d.source, e.dst, min(d.cost + e.cost) FROM d JOIN e ON d.node = e.src LEFT JOIN recurring.d k ON k.source = d.source AND k.node = e.dst WHERE d.cost + e.cost <= {ceiling} AND (k.cost IS NULL OR d.cost + e.cost < k.cost) GROUP BY d.source, e.dst))"""


def ends(t: Tables):
    """The first supplier and the one in the middle."""
    return t.supplier.agg(F.min("s_suppkey").alias("a"), F.floor(F.max("s_suppkey") / 2).alias("b")).select(F.explode(F.array("a", "b")).alias("source"))


@query(f"{_grid_search('1 + (src * 7 + dst * 13) % 10', 'SELECT unnest([min(s_suppkey), max(s_suppkey) // 2]) FROM supplier', 10**9)} SELECT source, node, cost FROM d")
def sssp_grid(t):
    return gr.shortest(grid(t), ends(t)).select("source", "node", "cost")


@query(f"{_grid_search('60 * (1 + (src * 7 + dst * 13) % 10)', 'SELECT min(s_suppkey) FROM supplier', 1800)}, m AS (SELECT source, node, cost, CAST(greatest(floor(cost * 1.9::DOUBLE / 60 + 0.5), 1) AS INTEGER) AS minutes FROM d) SELECT * FROM m WHERE minutes <= 30")
def travel_matrix(t):
    start = t.supplier.agg(F.min("s_suppkey").alias("source"))
    costs = gr.shortest(grid(t).withColumn("cost", F.col("cost") * 60), start, ceiling=1800)
    return gr.travel_minutes(costs, 1.9, 30).select("source", "node", "cost", "minutes")


_ONE_WAY = "NOT (src % 10 = 4 AND dst = src + 1) AND access >= 4 AND NOT (dst % 10 = 4 AND src = dst + 1)"


@query(f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_grid()}) WHERE {_ONE_WAY}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
c AS (SELECT x.a AS node, max(x.b) AS top FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), s AS (SELECT top, count(*) AS n FROM c GROUP BY top ORDER BY n DESC, top DESC LIMIT 1) SELECT node FROM c JOIN s USING (top)""")
def component_largest(t):
    return gr.largest_strong_component(grid(t).where(_ONE_WAY))
