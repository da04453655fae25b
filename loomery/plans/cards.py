"""Cards, requests and dialogue: computed columns, a whole search, calendar readings, turn folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import requests as rq
from ..operators import search as se
from .catalog import CARDS, cards
from .registry import Tables, query


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'top' WHEN c_acctbal >= 5000 THEN 'high' END AS balance_badge, CASE WHEN n >= 20 THEN 'veteran' WHEN n >= 15 THEN 'regular' END AS orders_badge, lower(c_mktsegment) AS kind
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def card_badges(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    balance = F.when(F.col("c_acctbal") >= 8000, "top").when(F.col("c_acctbal") >= 5000, "high")
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", balance.alias("balance_badge"), F.when(F.col("n") >= 20, "veteran").when(F.col("n") >= 15, "regular").alias("orders_badge"), F.lower("c_mktsegment").alias("kind"))


@query(f"SELECT s, kind, count(DISTINCT p) AS parts, min(price) AS lowest, array_to_string(list_sort(list_distinct(list(brand))), ',') AS brands FROM ({CARDS}) GROUP BY s, kind")
def catalog_flatten(t: Tables):
    return cards(t).groupBy("s", "kind").agg(F.count_distinct("p").alias("parts"), F.min("price").alias("lowest"), F.array_join(F.sort_array(F.collect_set("brand")), ",").alias("brands"))


@query("SELECT event_id, event_type AS name, CAST(user_id % 3 AS VARCHAR) AS shard, event_type || '{kind=' || substr(event_type, 1, 1) || ',shard=' || (user_id % 3) || '}' AS key FROM events")
def metric_keys(t: Tables):
    labels = F.create_map(F.lit("shard"), (F.col("user_id") % 3).cast("string"), F.lit("kind"), F.substring("event_type", 1, 1))
    key = tx.metric_key(F.col("event_type"), labels)
    return t.events.select("event_id", tx.metric_name(key).alias("name"), tx.metric_labels(key)["shard"].alias("shard"), key.alias("key"))


@query("SELECT c_custkey FROM customer WHERE c_name LIKE '%#0000000_1%' AND contains(lower(c_mktsegment), 'uil')")
def like_filter(t: Tables):
    return t.customer.where(F.col("c_name").like("%#0000000_1%") & F.contains(F.lower("c_mktsegment"), F.lit("uil"))).select("c_custkey")


@query(f"""
SELECT s * 1000000 + p AS id, row_number() OVER (ORDER BY rating DESC, price, s * 1000000 + p) AS rank FROM ({CARDS})
WHERE kind IN ('PROMO', 'LARGE') AND city NOT IN (4) AND rating >= 500 AND size BETWEEN 3 AND 40 ORDER BY rank LIMIT 7""")
def search_request(t: Tables):
    request, errors = rq.Request.read({"kinds": ["PROMO", "LARGE"], "not_cities": [4], "least_rating": 500.0, "least_size": 3, "most_size": 40, "limit": 7})
    assert not errors
    c = cards(t).withColumn("id", F.col("s") * 1_000_000 + F.col("p"))
    best, _, _ = rq.find(c, request, [F.desc("rating"), F.col("price"), F.col("id")])
    return best.select("id", "rank")


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS today, CAST(o_orderkey % 31 + 1 AS INTEGER) AS day FROM orders),
c AS (SELECT o_orderkey, today, day, CAST(date_trunc('month', today) + to_months(CAST(i AS INTEGER)) AS DATE) AS f FROM d, (SELECT unnest([0, 1, 2, 3]) AS i)),
v AS (SELECT o_orderkey, f + day - 1 AS x FROM c WHERE day <= day(last_day(f)) AND f + day - 1 >= today AND f + day - 1 <= CAST(today + INTERVAL 3 MONTH AS DATE))
SELECT d.o_orderkey, CAST(min(x) AS VARCHAR) AS date FROM d LEFT JOIN v ON d.o_orderkey = v.o_orderkey GROUP BY 1""")
def calendar_day(t: Tables):
    today = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", rq.day_of_month(today, (F.col("o_orderkey") % 31 + 1).cast("int")).cast("string").alias("date"))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey % 24 AS a, l_suppkey % 24 AS b FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN a BETWEEN 1 AND 7 THEN (a + 12) * 60 ELSE a * 60 END AS x, unnest(CASE WHEN b BETWEEN 1 AND 7 THEN [(b + 12) * 60] WHEN b BETWEEN 8 AND 11 THEN [b * 60, (b + 12) * 60] ELSE [b * 60] END) AS y FROM h)
SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(min(y - x) AS BIGINT) AS shortest FROM r WHERE x < y GROUP BY 1, 2""")
def hour_readings(t: Tables):
    pairs = rq.windows_of(F.col("l_partkey") % 24, F.col("l_suppkey") % 24)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", pairs.alias("w")).select("l_orderkey", "l_linenumber", F.explode("w").alias("w"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("w.to") - F.col("w.from")).alias("shortest"))


@query("""
WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) END AS asked, CASE WHEN length(text) % 2 = 0 THEN role END AS who FROM conversations)
SELECT conv_id, CAST(arg_max(asked, turn) FILTER (asked IS NOT NULL) AS BIGINT) AS asked, arg_max(who, turn) FILTER (who IS NOT NULL) AS who FROM f GROUP BY conv_id""")
def turn_folding(t: Tables):
    f = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text").cast("long")).alias("asked"), F.when(F.length("text") % 2 == 0, F.col("role")).alias("who"))
    return rq.fold_turns(f, "conv_id", "turn", ["asked", "who"])


@query()
def said_conditions(t: Tables):
    return t.conversations.select("conv_id", "turn", rq.conditions(F.col("text")).alias("c")).select("conv_id", "turn", F.size("c.days").alias("n_days"), "c.after", "c.before", "c.most_price")


@query("SELECT o_orderkey, CASE WHEN TRY_CAST(d AS DATE) IS NOT NULL THEN 1 ELSE 0 END AS valid FROM (SELECT o_orderkey, '2024-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') AS d FROM orders)")
def calendar_validity(t: Tables):
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    d = F.concat(F.lit("2024-"), pad(F.col("o_orderkey") % 12 + 1), F.lit("-"), pad(F.col("o_orderkey") % 31 + 1))
    return t.orders.select("o_orderkey", d.try_cast("date").isNotNull().cast("int").alias("valid"))


@query(f"SELECT kind, size, count(*) AS n FROM ({CARDS}) WHERE kind = 'PROMO' OR s = 2 GROUP BY kind, size")
def grouped_sections(t: Tables):
    return se.matching(cards(t), {"kind": F.col("kind") == "PROMO"}, F.col("s") == 2).groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n"))
