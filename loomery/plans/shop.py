"""Searches with travel and coverage, plans, bookings and laboratory quotes over the catalog stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hours import WEEK, in_windows, intervals, week_map, works_after, works_before, works_weekend
from ..functions.numbers import distance_label, price_label
from ..functions.timeops import days_to_ready, ready_at, rounded_up_clock
from ..operators import basket as bk
from ..operators import graph as gr
from ..operators import ledger as lg
from ..operators import schedule as sc
from ..operators import search as se
from .catalog import CARDS, OFFERS, cards, offers
from .places import BASKET, FEES, HOURS, QUOTE, SLOTS, TESTS, basket, fees, hours, quotes, slots, tests
from .registry import Tables, query
from .routes import DEPOTS, _search, depots, roads

SUPPLIER = "SELECT s_suppkey AS s, s_nationkey % 3 AS k FROM supplier"


@query("SELECT s_suppkey, (CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'day off' ELSE 'open' END IS NOT NULL AND s_suppkey % 4 <> 1) OR s_suppkey % 6 = 5 AS weekend FROM supplier")
def weekend_presence(t):
    s = F.col("s_suppkey")
    week = F.create_map(F.lit("sa"), F.when(s % 4 == 1, "Day off").when(s % 4 != 0, "09:00-14:00"), F.lit("su"), F.when(s % 6 == 5, "10:00-12:00"))
    return t.supplier.select("s_suppkey", works_weekend(week).alias("weekend"))


@query(f"""
WITH d AS (SELECT s, 'k' || k AS k, list_filter(['consult.k' || k || '.first', 'consult.k' || k || '.repeat', 'scan.' || s % 5, 'test.' || s % 2], lambda x: x <> 'consult.k2.repeat') AS v, unnest(['first', 'repeat', 'procedure', 'any', 'exact']) AS visit FROM ({SUPPLIER}))
SELECT s, visit, array_to_string(CASE visit WHEN 'first' THEN list_filter(v, lambda x: x = 'consult.' || k || '.first') WHEN 'repeat' THEN list_filter(v, lambda x: x = 'consult.' || k || '.repeat') WHEN 'procedure' THEN list_filter(v, lambda x: NOT starts_with(x, 'consult.')) WHEN 'exact' THEN list_filter(v, lambda x: x = 'scan.3') ELSE v END, ',') AS services FROM d""")
def visit_services(t):
    k, s = (F.col("s_nationkey") % 3).cast("string"), F.col("s_suppkey")
    have = F.array(F.concat(F.lit("consult.k"), k, F.lit(".first")), F.concat(F.lit("consult.k"), k, F.lit(".repeat")), F.concat(F.lit("scan."), (s % 5).cast("string")), F.concat(F.lit("test."), (s % 2).cast("string")))
    rows = t.supplier.select(s.alias("s"), F.concat(F.lit("k"), k).alias("k"), F.filter(have, lambda x: x != "consult.k2.repeat").alias("v"), F.explode(F.array(*[F.lit(x) for x in ("first", "repeat", "procedure", "any", "exact")])).alias("visit"))
    exact = F.when(F.col("visit") == "exact", "scan.3")
    return rows.select("s", "visit", F.array_join(se.services_for(F.col("v"), F.col("k"), F.col("visit"), exact), ",").alias("services"))


@query(f"SELECT s, count(*) AS n, array_to_string(list_sort(list(p)), ',') AS services FROM ({OFFERS}) WHERE price <= 150000 OR p % 7 = 0 GROUP BY s")
def affordable_services(t):
    """Of each supplier's services those under the ceiling or covered by the plan; suppliers without any are out."""
    listed = offers(t).groupBy("s").agg(F.array_sort(F.collect_list(F.struct(F.col("p").alias("service"), "price", (F.col("p") % 7 == 0).alias("covered")))).alias("v"))
    kept = listed.select("s", se.affordable(F.col("v"), F.lit(150_000), F.lit(True)).alias("v")).where(F.size("v") > 0)
    return kept.select("s", F.size("v").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: x["service"]), ",").alias("services"))


@query(f"SELECT s, string_agg(p || '=' || price, ',' ORDER BY p) AS prices, string_agg(p || '=' || CASE WHEN p % 7 = 0 THEN 'covered' ELSE 'paid' END, ',' ORDER BY p) AS coverage FROM ({OFFERS}) GROUP BY s")
def price_coverage_maps(t):
    maps = se.option_maps(offers(t).withColumn("state", F.when(F.col("p") % 7 == 0, "covered").otherwise("paid")), ["s"], "p", "price", "state")
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return maps.select("s", flat("prices").alias("prices"), flat("coverage").alias("coverage"))


@query(f"SELECT s, p, to_json({{'doctor': {{'id': s, 'rating': CAST(floor(rating) AS BIGINT)}}, 'place': {{'district': district, 'city': city}}, 'price': price}}) AS option FROM ({CARDS})")
def option_view(t):
    doctor = F.struct(F.col("s").alias("id"), F.floor("rating").cast("long").alias("rating"))
    return cards(t).select("s", "p", F.to_json(F.struct(doctor.alias("doctor"), F.struct("district", "city").alias("place"), "price")).alias("option"))


MINUTES = f"m AS (SELECT node AS s, min(CAST(greatest(floor(cost * 1.0::DOUBLE / 60 + 0.5), 1) AS INTEGER)) AS minutes FROM d GROUP BY node)"


def minutes(t: Tables):
    """Least road minutes from any depot to each supplier, within an hour."""
    return gr.travel_minutes(gr.shortest(roads(t), depots(t), 3600), 1.0, 60).groupBy(F.col("node").alias("s")).agg(F.min("minutes").alias("minutes"))


@query(f"{_search(DEPOTS, 3600)}, {MINUTES} SELECT c.s, c.kind, min(c.price) AS price, min(m.minutes) AS minutes FROM ({CARDS}) c JOIN m ON c.s = m.s WHERE m.minutes <= 12 GROUP BY c.s, c.kind")
def travel_stage(t):
    kept = se.travel_stage(cards(t), minutes(t), "s", 12)
    return kept.groupBy("s", "kind").agg(F.min("price").alias("price"), F.min("minutes").alias("minutes"))


@query(f"""{_search(DEPOTS, 3600)}, {MINUTES}, c AS ({CARDS}), f AS (SELECT *, kind = 'PROMO' AS a, price <= 200000 AS b FROM c LEFT JOIN m ON c.s = m.s)
SELECT CAST(step AS BIGINT) AS step, stage, n FROM (SELECT unnest([0, 1, 2, 3]) AS step, unnest(['all', 'kind', 'price', 'travel']) AS stage, unnest([count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND minutes <= 10)]) AS n FROM f)""")
def travel_funnel(t):
    """A funnel whose last stage is the way to the place."""
    c = se.travel_stage(cards(t), minutes(t), "s")
    return se.funnel(c, {"kind": F.col("kind") == "PROMO", "price": F.col("price") <= 200_000, "travel": F.col("minutes") <= 10})


BEST = f"SELECT kind, s, row_number() OVER (PARTITION BY kind ORDER BY min(price), s) AS r FROM ({CARDS}) GROUP BY kind, s QUALIFY r <= 5"


@query(f"""
WITH b AS ({BEST}), p AS (SELECT c_custkey AS plan, CASE c_custkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE 'STANDARD' END AS k1, CASE c_custkey % 2 WHEN 0 THEN 'PROMO' ELSE 'LARGE' END AS k2, 'PROMO' AS k3 FROM customer),
x AS (SELECT p.*, (SELECT s FROM b WHERE kind = k1 ORDER BY r LIMIT 1) AS e1 FROM p), y AS (SELECT x.*, (SELECT min(r) FROM b WHERE kind = k2 AND s IS DISTINCT FROM e1) AS r2 FROM x),
z AS (SELECT y.*, b.s AS e2 FROM y LEFT JOIN b ON kind = k2 AND r = r2), w AS (SELECT z.*, (SELECT min(r) FROM b WHERE kind = k3 AND s IS DISTINCT FROM e1 AND s IS DISTINCT FROM e2) AS r3 FROM z), v AS (SELECT w.*, b.s AS e3 FROM w LEFT JOIN b ON kind = k3 AND r = r3)
SELECT plan, CAST(unnest([1, 2, 3]) AS INTEGER) AS step, unnest([e1, e2, e3]) AS s FROM v""")
def multi_stop_plan(t):
    key = F.col("c_custkey")
    kinds = F.array(F.when(key % 3 == 0, "PROMO").when(key % 3 == 1, "ECONOMY").otherwise("STANDARD"), F.when(key % 2 == 0, "PROMO").otherwise("LARGE"), F.lit("PROMO"))
    steps = t.customer.select(key.alias("plan"), F.posexplode(kinds).alias("i", "kind")).select("plan", (F.col("i") + 1).alias("step"), "kind")
    best = cards(t).groupBy("kind", "s").agg(F.min("price").alias("price"))
    return se.without_reuse(steps, best, "plan", "step", ["kind"], "s", ["price"])


@query("""
WITH p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'find' WHEN 1 THEN 'route' ELSE 'drop' END AS action, length(text) % 8 AS steps, length(text) % 6 AS asked FROM conversations)
SELECT conv_id, turn, CASE WHEN action NOT IN ('find', 'route') THEN 'unknown_action' WHEN steps > 5 THEN 'too_many_steps' WHEN asked = 5 THEN 'unknown_token' END AS error FROM p""")
def plan_validation(t):
    n = F.length("text")
    action = F.when(F.col("turn") % 3 == 0, "find").when(F.col("turn") % 3 == 1, "route").otherwise("drop")
    tokens = F.array(F.lit("@DOCTOR_A"), F.concat(F.lit("@PLACE_"), (n % 6).cast("string")))
    issued = F.array(*[F.lit(x) for x in ("@DOCTOR_A", "@PLACE_0", "@PLACE_1", "@PLACE_2", "@PLACE_3", "@PLACE_4")])
    return t.conversations.select("conv_id", "turn", se.plan_errors(action, n % 8, tokens, issued, ["find", "route"]).alias("error"))


@query(f"""
WITH b AS ({BASKET}), w AS (SELECT s_suppkey AS s, kind, size, fee_kind FROM supplier, b), o AS ({TESTS}), f AS (SELECT * FROM ({FEES}) WHERE (s + fee_kind) % 5 <> 0),
m AS (SELECT w.s, w.kind || ' ' || w.size AS name, w.fee_kind, o.price FROM w LEFT JOIN o ON w.s = o.s AND w.kind = o.kind AND w.size = o.size),
r AS (SELECT s, CASE WHEN price IS NULL THEN 'missing_test' ELSE 'test' END AS what, name, price FROM m
 UNION ALL SELECT k.s, CASE WHEN f.fee IS NULL THEN 'missing_fee' ELSE 'fee' END, CAST(k.fee_kind AS VARCHAR), f.fee FROM (SELECT DISTINCT s, fee_kind FROM m WHERE price IS NOT NULL) k LEFT JOIN f ON f.s = k.s AND f.fee_kind = k.fee_kind)
SELECT s, CASE WHEN price IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY s, price IS NULL ORDER BY what DESC, name) AS INTEGER) END AS line, what, name, price FROM r""")
def price_lines(t):
    code = lambda df: df.withColumn("code", F.concat_ws(" ", "kind", F.col("size").cast("string")))
    wanted = t.supplier.select(F.col("s_suppkey").alias("s")).crossJoin(code(basket(t)).select("code", "fee_kind"))
    known = fees(t).where((F.col("s") + F.col("fee_kind")) % 5 != 0)
    return bk.price_lines(wanted, code(tests(t)), known, "s", "code", "fee_kind", "price", "fee")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey % 40 AS slot, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'slot_past' WHEN o_orderkey % 9 = 0 THEN 'test_unavailable' WHEN o_totalprice < 5000 THEN 'price_changed' END AS reason FROM orders),
c AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS turn FROM r)
SELECT o_orderkey, coalesce(reason, CASE WHEN turn > 3 + slot % 4 THEN 'slot_full' END, 'booked') AS result FROM c""")
def lab_booking(t):
    rows = t.orders.withColumns({"slot": F.col("o_custkey") % 40, "capacity": 3 + F.col("o_custkey") % 40 % 4})
    past = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    refused = F.when(past, "slot_past").when(F.col("o_orderkey") % 9 == 0, "test_unavailable").when(F.col("o_totalprice") < 5000, "price_changed")
    return bk.admit(rows, "slot", ["o_orderdate", "o_orderkey"], refused, "capacity").select("o_orderkey", "result")


_DONE = "list_filter(acc[-1].used, lambda u: u.key = x[1].key)"
_TAKEN = "acc[-1].taken[x[1].side + 1]"
_DECIDED = f"""CASE WHEN x[1].kind = 'cancel' THEN CASE WHEN len({_DONE}) > 0 AND {_DONE}[1].side = x[1].side AND {_DONE}[1].alive THEN 'cancelled' ELSE 'nothing' END
 WHEN x[1].key IS NULL THEN 'no_key' WHEN len({_DONE}) > 0 THEN CASE WHEN {_DONE}[1].side = x[1].side THEN 'repeated' ELSE 'conflict' END
 WHEN x[1].reason IS NOT NULL THEN x[1].reason WHEN {_TAKEN} >= x[1].cap THEN 'slot_full' ELSE 'booked' END"""
_STEP = f"CASE {_DECIDED} WHEN 'booked' THEN 1 WHEN 'cancelled' THEN CASE WHEN x[1].future THEN -1 ELSE 0 END ELSE 0 END"
_BOOK_ROW = "{{'id': {0}, 'kind': {1}, 'side': {2}, 'key': {3}, 'reason': {4}, 'cap': {5}, 'future': {6}, 'result': {7}, 'taken': {8}, 'used': {9}}}"
_NO_BOOKINGS = "list_filter([{'key': '', 'side': CAST(0 AS BIGINT), 'alive': false}], lambda u: u.alive)"
_ROWS = _BOOK_ROW.format("id", "kind", "side", "key", "reason", "cap", "future", "''", "[CAST(0 AS BIGINT), CAST(0 AS BIGINT)]", _NO_BOOKINGS)
_MADE = _BOOK_ROW.format(
    *[f"x[1].{c}" for c in ("id", "kind", "side", "key", "reason", "cap", "future")], _DECIDED, f"[acc[-1].taken[1] + CASE WHEN x[1].side = 0 THEN {_STEP} ELSE 0 END, acc[-1].taken[2] + CASE WHEN x[1].side = 1 THEN {_STEP} ELSE 0 END]",
    f"CASE {_DECIDED} WHEN 'booked' THEN list_append(acc[-1].used, {{'key': x[1].key, 'side': x[1].side, 'alive': true}}) WHEN 'cancelled' THEN list_transform(acc[-1].used, lambda u: {{'key': u.key, 'side': u.side, 'alive': u.alive AND u.key <> x[1].key}}) ELSE acc[-1].used END")
_SEED = _BOOK_ROW.format("CAST(-1 AS BIGINT)", "''", "CAST(0 AS BIGINT)", "''", "CAST(NULL AS VARCHAR)", "CAST(0 AS BIGINT)", "false", "''", "[CAST(0 AS BIGINT), CAST(0 AS BIGINT)]", _NO_BOOKINGS)


@query(f"""
WITH f AS (SELECT l_suppkey % 10 AS branch, l_partkey AS code, CAST(min(floor(l_extendedprice / l_quantity * 100 + 0.5)) AS BIGINT) AS price FROM lineitem GROUP BY 1, 2),
o AS (SELECT o_orderkey AS id, o_custkey // 3 AS slot, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey // 3 + 1 ELSE o_custkey // 3 END % 10 AS branch, o_orderdate AS made, CASE WHEN o_orderkey % 5 = 0 THEN 'cancel' ELSE 'book' END AS kind,
 CASE WHEN o_orderkey % 50 <> 1 THEN (o_custkey // 6) || '-' || (o_orderkey % 23) END AS key, TIMESTAMP '1997-01-01' + to_days(CAST(o_custkey // 3 % 400 AS INTEGER)) AS starts FROM orders),
w AS (SELECT DISTINCT o.id, branch, l_partkey AS code, p_size % 3 AS kind FROM o JOIN lineitem ON l_orderkey = id JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 3),
m AS (SELECT w.*, price FROM w LEFT JOIN f USING (branch, code)), l AS (SELECT id, count(DISTINCT code) AS n, count(*) FILTER (price IS NULL) AS lacks, coalesce(sum(price), 0) AS items, sum(CASE WHEN code % 10 = 0 THEN 100 ELSE 0 END) AS dearer FROM m GROUP BY id),
d AS (SELECT id, count(*) FILTER (branch = 4 AND kind = 2) AS owes, coalesce(sum(100 * branch + kind) FILTER (NOT (branch = 4 AND kind = 2)), 0) AS fees FROM (SELECT DISTINCT id, branch, kind FROM m WHERE price IS NOT NULL) GROUP BY id),
z AS (SELECT o.*, slot // 2 AS g, slot % 2 AS side, slot % 4 + 2 AS cap, starts > made AS future, coalesce(n, 0) AS n, coalesce(lacks, 0) + coalesce(owes, 0) AS lacks, CAST(coalesce(items, 0) + coalesce(fees, 0) AS BIGINT) AS total, CASE WHEN id % 3 > 0 THEN coalesce(items, 0) + coalesce(fees, 0) + coalesce(dearer, 0) END AS expected FROM o LEFT JOIN l USING (id) LEFT JOIN d USING (id)),
r AS (SELECT *, CASE WHEN n = 0 OR n > 25 THEN 'bad_request' WHEN branch = 7 THEN 'branch_not_found' WHEN branch <> slot % 10 THEN 'slot_not_found' WHEN NOT future THEN 'slot_past' WHEN lacks > 0 THEN 'test_unavailable' WHEN expected <> total THEN 'price_changed' END AS reason FROM z),
q AS (SELECT g, list([{_ROWS}] ORDER BY made, id) AS v FROM r GROUP BY g), b AS (SELECT unnest(list_reduce(list_prepend([{_SEED}], v), lambda acc, x: acc || [{_MADE}])) AS x FROM q)
SELECT id AS o_orderkey, total, b.x.result AS result FROM b JOIN r ON r.id = b.x.id""")
def basket_bookings(t):
    """Orders as bookings of a laboratory's slots: total made anew, branch, slot, tests, key and capacity in one decision."""
    id_, cust = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 3)
    offers_ = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("branch"), F.col("l_partkey").alias("code")).agg(F.min(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5)).cast("long").alias("price"))
    branch = F.when(id_ % 13 == 0, cust + 1).otherwise(cust) % 10
    asked = t.orders.select(id_.alias("id"), cust.alias("slot"), branch.alias("branch"), F.col("o_orderdate").alias("at"), F.when(id_ % 5 == 0, "cancel").otherwise("book").alias("kind"), F.when(id_ % 50 != 1, F.concat_ws("-", F.floor(F.col("o_custkey") / 6).cast("string"), (id_ % 23).cast("string"))).alias("key"))
    lines = t.lineitem.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("code"))
    wanted = lines.join(t.part.select(F.col("p_partkey").alias("code"), (F.col("p_size") % 3).alias("kind")), "code")
    branches = t.spark.range(10).select(F.col("id").alias("branch"), (F.col("id") != 7).alias("active"))
    slot = F.col("slot")
    places = asked.select("slot").distinct().select("slot", (slot % 10).alias("branch"), F.date_add(F.lit("1997-01-01").cast("date"), (slot % 400).cast("int")).cast("timestamp_ntz").alias("starts"), (slot % 4 + 2).alias("capacity"))
    known = branches.crossJoin(t.spark.range(3).select(F.col("id").cast("int").alias("kind"))).where("NOT (branch = 4 AND kind = 2)").select("branch", "kind", (100 * F.col("branch") + F.col("kind")).alias("fee"))
    # what the sender saw: every tenth test is dearer by a whole unit there
    seen = wanted.distinct().groupBy("id").agg(F.sum(F.when(F.col("code") % 10 == 0, 100).otherwise(0)).alias("dearer"))
    cost = bk.booking_reasons(asked.withColumn("expected", F.lit(None).cast("long")), wanted, branches, places, offers_, known).select("id", "total")
    expected = cost.join(seen, "id", "left").select("id", F.when(F.col("id") % 3 > 0, F.col("total") + F.coalesce("dearer", F.lit(0))).alias("expected"))
    told = bk.booking_reasons(asked.join(expected, "id"), wanted, branches, places, offers_, known)
    return lg.book_places(told, "slot", "at", "id").select(F.col("id").alias("o_orderkey"), "total", "result")


@query(f"""{QUOTE}, x AS (SELECT s, total, CASE WHEN s % 6 = 0 THEN NULL ELSE CAST(s * 7 % 60 AS INTEGER) END AS minutes, slowest AS turnaround, CAST(s * 13 % 50 AS BIGINT) AS first_slot FROM q WHERE missing = 0), y AS (SELECT *, first_slot + turnaround AS ready, coalesce(minutes, 999) AS m FROM x),
r AS (SELECT s, unnest(['total', 'distance', 'turnaround', 'soonest']) AS mode, unnest([row_number() OVER (ORDER BY total, m, s), row_number() OVER (ORDER BY m, total, s), row_number() OVER (ORDER BY ready, turnaround, total, s), row_number() OVER (ORDER BY first_slot, total, s)]) AS rank FROM y)
SELECT mode, rank, s FROM r WHERE rank <= 8""")
def quote_sorts(t):
    s = F.col("s")
    rows = quotes(t).where("missing = 0").select("s", "total", F.when(s % 6 != 0, (s * 7 % 60).cast("int")).alias("minutes"), F.col("slowest").alias("turnaround"), (s * 13 % 50).alias("first_slot"))
    return bk.quote_ranks(rows.withColumn("ready", F.col("first_slot") + F.col("turnaround")), "s", 8)


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus IN ('O', 'P') THEN 0 ELSE 1 END, o_orderdate, o_orderkey DESC) AS place FROM orders ORDER BY place LIMIT 50""")
def request_queue(t):
    """Open requests first, then by date, then the newest; a page of fifty."""
    order = [F.when(F.col("o_orderstatus").isin("O", "P"), 0).otherwise(1), F.asc("o_orderdate"), F.desc("o_orderkey")]
    return se.top(t.orders, order, 50).select("o_orderkey", F.col("rank").alias("place"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate + to_hours(l_linenumber * 5), '%Y-%m-%d %H:%M:%S') END AS ready,
 CASE WHEN l_linenumber > 1 THEN CAST((9 + l_linenumber * 5) // 24 + CASE WHEN (9 + l_linenumber * 5) % 24 > 20 THEN 1 ELSE 0 END AS INTEGER) END AS days, CAST(least(ceil((l_partkey % 1000 + l_linenumber * 60) / 5.0) * 5, 1440) AS INTEGER) AS clock FROM lineitem""")
def ready_times(t):
    hours_ = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") * 5).otherwise(0)
    ready = F.date_format(ready_at(F.col("l_shipdate"), hours_), "yyyy-MM-dd HH:mm:ss")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ready.alias("ready"), days_to_ready(hours_).alias("days"), rounded_up_clock(F.col("l_partkey") % 1000, F.col("l_linenumber")).alias("clock"))


@query("""
WITH k AS (SELECT c_custkey, (c_custkey * 37 % 500) / 20.0::DOUBLE AS km, c_acctbal AS p FROM customer)
SELECT c_custkey, CASE WHEN km < 1 THEN CAST(greatest(CAST(floor(km * 20 + 0.5) AS INTEGER) * 50, 50) AS VARCHAR) || ' m' WHEN km < 10 THEN printf('%.1f', floor(km * 10 + 0.5) / 10) || ' km' ELSE CAST(CAST(floor(km + 0.5) AS INTEGER) AS VARCHAR) || ' km' END AS distance,
 CASE WHEN p > 0 THEN 'from ' || CAST(floor(p + 0.5) AS BIGINT) END AS price FROM k""")
def card_labels(t):
    km = F.col("c_custkey") * 37 % 500 / 20.0
    return t.customer.select("c_custkey", distance_label(km).alias("distance"), price_label(F.col("c_acctbal")).alias("price"))


@query(f"""
WITH a AS (SELECT s_suppkey AS s, day, start, 'demo' AS source FROM ({SLOTS}) WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS s, day, start + 10 AS start, 'external' AS source FROM ({SLOTS}) WHERE s_suppkey % 3 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT s, day, CAST(start AS INTEGER) AS start, source, row_number() OVER (PARTITION BY s, day ORDER BY start, source) AS turn FROM u""")
def merged_slots(t):
    rows = slots(t).select(F.col("s_suppkey").alias("s"), "day", "start")
    return sc.merged_sources({"demo": rows.where("s % 2 = 0"), "external": rows.where("s % 3 = 0").withColumn("start", F.col("start") + 10), "failed": None}, ["s", "day"], "start")


@query(f"""
WITH c AS (SELECT s, kind, min(price) AS price FROM ({CARDS}) GROUP BY s, kind), n AS (SELECT *, CASE WHEN s % 9 = 2 THEN 'pinned' ELSE kind END AS section FROM c)
SELECT s, kind, section, dense_rank() OVER (ORDER BY CASE WHEN section = 'pinned' THEN 0 ELSE 1 END, section) AS section_rank, row_number() OVER (PARTITION BY section ORDER BY price, s, kind) AS place FROM n""")
def ranked_sections(t):
    c = cards(t).groupBy("s", "kind").agg(F.min("price").alias("price"))
    return se.sections(c, F.col("s") % 9 == 2, "kind", [F.col("price"), F.col("s"), F.col("kind")]).select("s", "kind", "section", "section_rank", "place")


@query("""
SELECT o_orderkey, o_custkey % 5 <> 0 AND o_orderkey % 4 + o_custkey % 3 < 4 AND o_orderdate > TIMESTAMP '1996-01-01' AS room FROM orders""")
def slot_capacity(t):
    blocked = F.when(F.col("o_custkey") % 5 == 0, True).when(F.col("o_custkey") % 5 == 1, False)
    return t.orders.select("o_orderkey", sc.has_room(blocked, F.col("o_orderkey") % 4, F.col("o_custkey") % 3, F.lit(4), F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz")).alias("room"))


@query(f"""
WITH h AS (SELECT s, x[1] AS a, x[2] AS b FROM ({HOURS})), g AS (SELECT s, bool_or(b > 1080) AS late, bool_or(a < 540) AS early, bool_or(a >= 480 AND a < 540 OR a >= 1200 AND a < 1260) AS windowed FROM h GROUP BY s)
SELECT s_suppkey, late, early, windowed FROM supplier LEFT JOIN g ON s = s_suppkey""")
def works_when(t):
    """Strict bounds on any interval, and starts in either of two windows; unknown hours stay unknown."""
    known = hours(t).select("s_suppkey", intervals(F.col("hours")).alias("x"))
    windows = [(480, 540), (1200, 1260)]
    return known.select("s_suppkey", works_after(F.col("x"), 1080).alias("late"), works_before(F.col("x"), 540).alias("early"), F.exists("x", lambda i: in_windows(i["from"], windows)).alias("windowed"))


@query("""
SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0) AND CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal > 2000 END AND list_contains(CASE WHEN c_custkey % 2 = 0 THEN ['adult', 'child'] ELSE ['adult'] END, 'child')""")
def feature_and_group(t):
    """Features must be true, not merely not false; the patient must be among the groups."""
    groups = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("adult"), F.lit("child"))).otherwise(F.array(F.lit("adult")))
    stages = {"access": F.col("c_custkey") % 3 == 0, "parking": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") > 2000), "group": F.array_contains(groups, "child")}
    return se.matching(t.customer, stages).select("c_custkey")


_DAYS = "['Mo', 'Tu', 'We', 'Th', 'Fr', 'Sa', 'Su']"


@query(f"""
WITH k AS (SELECT s_suppkey, s_suppkey % 7 AS a, s_suppkey // 7 % 7 AS b, s_suppkey // 3 % 7 AS c, 6 + s_suppkey % 5 AS h, 15 + s_suppkey % 12 AS e FROM supplier)
SELECT s_suppkey, CASE WHEN e <= 24 THEN array_to_string(list_transform([0, 1, 2, 3, 4, 5, 6], lambda d: CASE WHEN d = c THEN 'closed' WHEN (d - a + 7) % 7 <= (b - a + 7) % 7 THEN printf('%02d:00-12:00,13:30-%02d:15', h, e) ELSE 'closed' END), '|') END AS week FROM k""")
def week_of_hours(t):
    """Rules written out of the keys; hours above 24 make the text unreadable."""
    k = F.col("s_suppkey")
    day = lambda n: F.get(F.array(*[F.lit(d.capitalize()) for d in WEEK]), n.cast("int"))
    text = F.concat(day(k % 7), F.lit("-"), day(F.floor(k / 7) % 7), F.lit(" "), (6 + k % 5).cast("string"), F.lit(":00 - 12:00, 13:30-"), (15 + k % 12).cast("string"), F.lit(":15; "), day(F.floor(k / 3) % 7), F.lit(" off || call first"))
    return t.supplier.select("s_suppkey", week_map(text).alias("w")).select("s_suppkey", F.when(F.col("w").isNotNull(), F.array_join(F.map_values("w"), "|")).alias("week"))


@query(f"""{QUOTE}, x AS (SELECT s, missing, total, slowest AS turnaround, CASE WHEN s % 6 = 0 THEN NULL ELSE s * 7 % 60 END AS minutes FROM q),
z AS (SELECT s_suppkey AS s, count(*) AS slots FROM ({SLOTS}) WHERE start < 720 GROUP BY 1),
y AS (SELECT x.*, coalesce(slots, 0) AS slots FROM x LEFT JOIN z USING (s)), c AS (SELECT *, missing = 0 AS a, missing = 0 AND total <= 5500 AS b, missing = 0 AND total <= 5500 AND turnaround <= 40 AS d, missing = 0 AND total <= 5500 AND turnaround <= 40 AND coalesce(minutes <= 45, false) AS e FROM y)
SELECT unnest(['branches', 'complete', 'price', 'turnaround', 'travel', 'slots']) AS stage, unnest([count(*), count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (d), count(*) FILTER (e), count(*) FILTER (e AND slots > 0)]) AS branches FROM c""")
def quote_funnel(t):
    """A quote with limits on price, turnaround and travel, for fasting tests: slots before noon."""
    s = F.col("s")
    rows = quotes(t).select("s", "missing", "total", F.col("slowest").alias("turnaround"), F.when(s % 6 != 0, s * 7 % 60).alias("minutes"))
    free = slots(t).select(F.col("s_suppkey").alias("s"), "day", F.col("start").alias("minute"))
    return bk.quote_funnel(bk.quote_options(rows, free, "s", 5500, 40, 45, fasting=True))
