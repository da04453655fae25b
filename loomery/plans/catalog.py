"""Search, ranking, joins and sets over suppliers, parts and orders.

Stand-ins: an offer is a (supplier, part) of `lineitem` with its cheapest price per unit in cents; a
supplier's nation is its district, its region its city.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cents
from ..operators import joins as jn
from ..operators import search as se
from .registry import Tables, query

OFFERS = """SELECT l_suppkey AS s, l_partkey AS p, CAST(min(floor(l_extendedprice / l_quantity * 100 + 0.5)) AS BIGINT) AS price, count(*) AS n,
  CAST(max(l_linenumber) AS INTEGER) AS line FROM lineitem GROUP BY 1, 2"""
CARDS = f"""SELECT o.s, o.p, o.price, o.n, n_name AS district, n_regionkey AS city, p_type AS kind, p_size AS size, p_brand AS brand, s_acctbal AS rating
  FROM ({OFFERS}) o JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON p = p_partkey"""


def offers(t: Tables):
    price = F.min(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5)).cast("long")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(price.alias("price"), F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("int").alias("line"))


def cards(t: Tables):
    joined = offers(t).join(t.supplier, F.col("s") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.part, F.col("p") == F.col("p_partkey"))
    return joined.select("s", "p", "price", "n", F.col("n_name").alias("district"), F.col("n_regionkey").alias("city"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("s_acctbal").alias("rating"))


STAGES = {"kind": "kind = 'PROMO'", "size": "size BETWEEN 5 AND 30", "city": "city IN (1, 2)", "price": "price <= 200000", "rating": "rating >= 1000"}


def stages():
    return {k: F.expr(v) for k, v in STAGES.items()}


def _and(names) -> str:
    return " AND ".join(f"coalesce({STAGES[n]}, false)" for n in names) or "true"


def _rows(choices: list[tuple[str, str]], key: str) -> str:
    counts = ", ".join(f"count(*) FILTER ({cond}) AS c{i}" for i, (_, cond) in enumerate(choices))
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, '{name}' AS {key}, c{i} AS n FROM c" for i, (name, _) in enumerate(choices))
    return f"WITH c AS (SELECT {counts} FROM ({CARDS})) {rows}"


NAMES = list(STAGES)


@query(_rows([("all", "true")] + [(n, _and(NAMES[: i + 1])) for i, n in enumerate(NAMES)], "stage"))
def funnel_stages(t):
    return se.funnel(cards(t), stages())


@query(f"""WITH f AS ({_rows([("all", "true")] + [(n, _and(NAMES[: i + 1]) + (" AND size > 60" if n in ("city", "price", "rating") else "")) for i, n in enumerate(NAMES)], "stage")})
SELECT (SELECT stage FROM f WHERE n = 0 ORDER BY step LIMIT 1) AS stage, (SELECT min(step) FROM f WHERE n = 0) AS step""")
def blocking_stage(t):
    impossible = stages() | {"city": F.expr(STAGES["city"] + " AND size > 60")}
    return se.blocking_stage(cards(t), impossible)


@query(_rows([(n, _and([m for m in NAMES if m != n])) for n in NAMES], "dropped"))
def relax_one(t):
    return se.relaxations(cards(t), stages(), 1)


@query(_rows([(f"{a}+{b}", _and([m for m in NAMES if m not in (a, b)])) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]], "dropped"))
def relax_pairs(t):
    return se.relaxations(cards(t), stages(), 2)


ORDER = ["rating", "price", "city"]
TIGHT = STAGES | {"price": "price <= 1"}


@query(f"""WITH c AS (SELECT {', '.join('count(*) FILTER (' + ' AND '.join(f'coalesce({TIGHT[n]}, false)' for n in NAMES if n not in ORDER[:i]) + f') AS c{i}' for i in range(4))} FROM ({CARDS})),
r AS ({' UNION ALL '.join(f"SELECT CAST({i} AS BIGINT) AS step, '{'+'.join(ORDER[:i])}' AS dropped, c{i} AS n FROM c" for i in range(4))})
SELECT min(step) AS step, arg_min(dropped, step) AS dropped, arg_min(n, step) AS n FROM r WHERE n > 0""")
def relax_sequential(t):
    return se.relax_in_order(cards(t), {k: F.expr(v) for k, v in TIGHT.items()}, ORDER)


@query(f"SELECT s, p, price FROM ({CARDS}) WHERE ({_and(NAMES)}) OR s = 1")
def faceted_filter(t):
    return se.matching(cards(t), stages(), pinned=F.col("s") == 1).select("s", "p", "price")


@query(f"SELECT brand, count(*) AS n FROM ({CARDS}) WHERE {_and([n for n in NAMES if n != 'kind'])} GROUP BY brand")
def facet_counts(t):
    return se.without_own(cards(t), stages(), "kind", "brand")


@query(f"""
WITH c AS (SELECT *, s * 1000000 + p AS id, CASE WHEN n > 1 THEN price END AS maybe FROM ({CARDS})),
u AS (SELECT 'rating' AS mode, id, row_number() OVER (ORDER BY rating DESC, id) AS rank FROM c
 UNION ALL SELECT 'price', id, row_number() OVER (ORDER BY maybe NULLS LAST, id) FROM c
 UNION ALL SELECT 'name', id, row_number() OVER (ORDER BY brand, id) FROM c
 UNION ALL SELECT 'recommendation', id, row_number() OVER (ORDER BY (size % 2 = 0) DESC, (s % 7 = 0) DESC, rating DESC, city, n DESC, id) FROM c)
SELECT * FROM u WHERE rank <= 20""")
def sort_modes(t):
    c = cards(t).select((F.col("s") * 1_000_000 + F.col("p")).alias("id"), "rating", F.col("brand").alias("name"), F.when(F.col("n") > 1, F.col("price")).alias("price"), (F.col("size") % 2 == 0).alias("open"), (F.col("s") % 7 == 0).alias("favourite"), F.col("city").alias("distance"), F.col("n").alias("experience"))
    parts = [se.top(c, se.sort_keys(m), 20).select(F.lit(m).alias("mode"), "id", "rank") for m in ("rating", "price", "name", "recommendation")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""
WITH c AS (SELECT *, coalesce(bool_or(price < 95000) OVER (PARTITION BY s), false) AS narrowed FROM ({CARDS}))
SELECT s, p, price, narrowed FROM c WHERE NOT narrowed OR price < 95000""")
def soft_window_pref(t):
    return se.prefer(cards(t), ["s"], F.col("price") < 95_000).select("s", "p", "price", "narrowed")


@query("""
WITH v AS (SELECT DISTINCT lower(trim(p_name)) AS value FROM part WHERE contains(lower(trim(p_name)), 'old'))
SELECT value, row_number() OVER (ORDER BY starts_with(value, 'old') DESC, length(value), value) AS rank FROM v ORDER BY rank LIMIT 8""")
def suggestions(t):
    return se.suggestions(t.part, "p_name", "old")


@query(f"""
WITH r AS (SELECT kind, brand, district, row_number() OVER (PARTITION BY kind ORDER BY rating DESC, price, s, p) AS rank FROM ({CARDS})),
u AS (SELECT *, 1 AS turn FROM r WHERE rank <= 12 UNION ALL SELECT *, 2 FROM r), l AS (SELECT kind, list([{{'rank': rank, 'brand': brand, 'district': district, 'turn': turn, 'pick': CAST(1 AS BIGINT)}}] ORDER BY turn, rank) AS l FROM u GROUP BY kind),
f AS (SELECT kind, list_reduce(l, lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda y: y.brand = x[1].brand OR x[1].turn = 1 AND y.district = x[1].district)) = 0
 THEN acc || [{{'rank': x[1].rank, 'brand': x[1].brand, 'district': x[1].district, 'turn': x[1].turn, 'pick': CAST(len(acc) + 1 AS BIGINT)}}] ELSE acc END) AS f FROM l)
SELECT kind, x.rank AS rank, x.pick AS pick FROM (SELECT kind, unnest(f) AS x FROM f)""")
def diverse_topk(t):
    ranked = se.ranked(cards(t), [F.desc("rating"), F.col("price"), F.col("s"), F.col("p")], within=["kind"])
    return se.diverse_picks(ranked, ["kind"], "rank", person="brand", place="district")


@query(f"""SELECT kind, s, p, price, ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY kind, size ORDER BY rating DESC, price, s, p) AS r, count(*) OVER (PARTITION BY kind, size) > 1 AS ambiguous FROM ({CARDS})) WHERE r = 1""")
def disambiguation(t):
    return se.disambiguate(cards(t), ["kind", "size"], [F.desc("rating"), F.col("price"), F.col("s"), F.col("p")]).select("kind", "s", "p", "price", "ambiguous")


@query("SELECT o_orderkey, o_custkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paging_total(t):
    return se.page(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 2).select("o_orderkey", "o_custkey", "total")


@query("""
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS due, o_orderstatus FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, due NULLS LAST, o_orderkey DESC) AS rank FROM c""")
def nulls_last_sort(t):
    c = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("due"), "o_orderstatus")
    turn = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return se.ranked_all(c, [turn, F.asc_nulls_last("due"), F.desc("o_orderkey")]).select("o_orderkey", "rank")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def inner_join(t):
    return t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def left_join(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09)")
def semi_join(t):
    return t.supplier.join(t.lineitem.where("l_discount > 0.09"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def snapshots(t: Tables):
    columns = ["p_partkey", "p_brand", "p_size", "price"]
    price = cents(F.col("p_retailprice"))
    before = t.part.where("p_partkey % 10 <> 0").withColumn("price", price)
    after = t.part.where("p_partkey % 11 <> 0").withColumns({"p_brand": F.when(F.col("p_partkey") % 7 == 0, "Brand#X").otherwise(F.col("p_brand")), "price": F.when(F.col("p_partkey") % 5 == 0, price * 2).when(F.col("p_partkey") % 3 == 0, F.floor(price * 1.1).cast("long")).otherwise(price)})
    return before.select(*columns), after.select(*columns)


PRICE = "CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)"
BEFORE = f"SELECT p_partkey, p_brand, p_size, {PRICE} AS price FROM part WHERE p_partkey % 10 <> 0"
AFTER = f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#X' ELSE p_brand END AS p_brand, p_size,
  CASE WHEN p_partkey % 5 = 0 THEN {PRICE} * 2 WHEN p_partkey % 3 = 0 THEN CAST(floor({PRICE} * 1.1::DOUBLE) AS BIGINT) ELSE {PRICE} END AS price FROM part WHERE p_partkey % 11 <> 0"""
DIFF = f"""
WITH b AS ({BEFORE}), a AS ({AFTER}), j AS (SELECT coalesce(b.p_partkey, a.p_partkey) AS k, b.p_partkey AS bk, a.p_partkey AS ak, b.p_brand AS b1, a.p_brand AS a1, b.p_size AS b2, a.p_size AS a2, b.price AS b3, a.price AS a3 FROM b FULL JOIN a ON a.p_partkey = b.p_partkey)
SELECT k AS p_partkey, CASE WHEN bk IS NULL THEN 'added' ELSE 'removed' END AS change, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM j WHERE bk IS NULL OR ak IS NULL
UNION ALL SELECT k, 'changed', 'p_brand', b1, a1 FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND b1 IS DISTINCT FROM a1
UNION ALL SELECT k, 'changed', 'p_size', CAST(b2 AS VARCHAR), CAST(a2 AS VARCHAR) FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND b2 IS DISTINCT FROM a2
UNION ALL SELECT k, 'changed', 'price', CAST(b3 AS VARCHAR), CAST(a3 AS VARCHAR) FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND b3 IS DISTINCT FROM a3"""


@query(DIFF)
def full_outer_diff(t):
    return jn.keyed_diff(*snapshots(t), ["p_partkey"], ["p_brand", "p_size", "price"])


@query("SELECT a.r_regionkey AS a, b.n_nationkey AS b, d.day FROM region a CROSS JOIN nation b CROSS JOIN (SELECT CAST(range AS INTEGER) AS day FROM range(14)) d")
def cross_join_pairs(t):
    days = F.explode(F.sequence(F.lit(0), F.lit(13)))
    return t.region.crossJoin(t.nation).select(F.col("r_regionkey").alias("a"), F.col("n_nationkey").alias("b"), days.alias("day"))


@query("""
WITH k AS (SELECT DISTINCT lower(p_name) AS v FROM part), w AS (SELECT unnest(['bolt', 'old', 'cold widget', 'large bolt extra', 'zinc']) AS w),
m AS (SELECT v, w, row_number() OVER (PARTITION BY v ORDER BY w) AS r FROM k JOIN w ON contains(v, w) OR contains(w, v))
SELECT v, w FROM m WHERE r = 1""")
def theta_contains_join(t):
    names = t.part.select(F.lower("p_name").alias("v")).distinct()
    words = t.spark.createDataFrame([(w,) for w in ("bolt", "old", "cold widget", "large bolt extra", "zinc")], "w string")
    return jn.containment(names, words, "v", "w", ["v"], "w").select("v", "w")


@query("""
WITH r AS (SELECT s_suppkey, s_suppkey % 300 AS low, s_suppkey % 300 + 5 + s_suppkey % 40 AS high FROM supplier)
SELECT e.event_id, r.s_suppkey FROM events e JOIN r ON CAST(floor(e.value) AS BIGINT) >= low AND CAST(floor(e.value) AS BIGINT) < high""")
def range_join(t):
    points = t.events.select("event_id", F.floor("value").cast("long").alias("v"))
    low = F.col("s_suppkey") % 300
    ranges = t.supplier.select("s_suppkey", low.alias("low"), (low + 5 + F.col("s_suppkey") % 40).alias("high"))
    return jn.range_join(points, ranges, "v", "low", "high", 16).select("event_id", "s_suppkey")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS search_id, v.value AS search_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.event_id >= v.event_id""")
def asof_join(t):
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id")
    seen = t.events.where("event_type = 'view'").select("event_id", "user_id", F.col("event_id").alias("search_id"), F.col("value").alias("search_value"))
    return jn.as_of(bought, seen, ["user_id"], "event_id", ["search_id", "search_value"])


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer")
def correlated_count(t):
    counts = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("open_orders"))
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("open_orders", F.lit(0)).alias("open_orders"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, p_brand FROM part")
def union_all(t):
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def intersect_q(t):
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")).intersect(t.lineitem.where("l_quantity >= 49").select("l_partkey"))


@query("SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def except_q(t):
    return t.part.select(F.col("p_partkey").alias("part")).subtract(t.lineitem.where("l_quantity >= 49").select("l_partkey"))


@query("SELECT DISTINCT p_type AS kind, p_brand AS brand FROM part")
def facet_domains(t):
    return t.part.select(F.col("p_type").alias("kind"), F.col("p_brand").alias("brand")).distinct()


@query("""
WITH h AS (SELECT l_suppkey AS s, list_distinct(list(l_shipmode)) AS x FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1)
SELECT s, len(x) AS n, list_has_all(x, ['RF', 'AO']) AS has_all, list_has_any(x, ['NO']) AS has_any FROM h""")
def set_containment(t):
    have = t.lineitem.groupBy(F.col("l_suppkey").alias("s")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("x"))
    wanted = F.array(F.lit("RF"), F.lit("AO"))
    return have.select("s", F.size("x").cast("long").alias("n"), (F.size(F.array_except(wanted, "x")) == 0).alias("has_all"), F.arrays_overlap("x", F.array(F.lit("NO"))).alias("has_any"))


@query("""
SELECT s_suppkey, o_orderkey, slot FROM (
  SELECT l_suppkey AS s_suppkey, l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS slot FROM lineitem) WHERE slot <= 6""")
def slots_top_k(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber")
    return se.ranked(rows, [F.col("l_shipdate"), F.col("o_orderkey"), F.col("l_linenumber")], "slot", ["s_suppkey"]).where("slot <= 6").select("s_suppkey", "o_orderkey", "slot")
