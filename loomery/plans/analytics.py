"""Event and telemetry queries over `events`, `orders` and `customer`.

Stand-ins: a view is a search, a click opens a result, a purchase is an action, a signup is positive
feedback, an error is a report; the session is the user, the log order is event_id, the day is local.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import band, bin_of, cents, percent
from ..functions.timeops import dense, local_day, local_hour, local_weekday
from ..operators import events as ev
from ..operators import telemetry as tm
from .registry import Tables, query

KINDS = lambda: ev.Kinds(search=F.col("event_type") == "view", opened=F.col("event_type") == "click", action=F.col("event_type") == "purchase", satisfied=F.col("event_type") == "signup", session="user_id", order="event_id")
LOG = "SELECT *, CAST(CAST(ts + INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day FROM events"
NUMBERED = f"SELECT *, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY day, user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS search_no FROM ({LOG})"
PCT = "CASE WHEN {1} <> 0 THEN floor({0} * 1000.0::DOUBLE / {1} + 0.5) / 10.0::DOUBLE END"
CENTS = "CAST(floor({0} * 100 + 0.5) AS BIGINT)"


def log(t: Tables):
    return t.events.withColumn("day", local_day(F.col("ts")).cast("string"))


@query(f"""
WITH n AS ({NUMBERED}),
s AS (SELECT day, user_id, bool_or(event_type = 'view') AS searched, bool_or(event_type = 'click') AS opened,
             bool_or(event_type = 'purchase') AS acted, bool_or(event_type = 'signup') AS satisfied FROM n GROUP BY ALL),
f AS (SELECT day, count(*) AS sessions, count(*) FILTER (searched) AS searched, count(*) FILTER (opened) AS opened,
             count(*) FILTER (acted) AS acted, count(*) FILTER (satisfied) AS satisfied FROM s GROUP BY day),
a AS (SELECT day, user_id, search_no, bool_or(event_type IN ('purchase', 'signup')) AS ok FROM n WHERE search_no > 0 GROUP BY ALL),
c AS (SELECT day, count(*) AS searches, count(*) FILTER (ok) AS successful FROM a GROUP BY day),
j AS (SELECT f.*, coalesce(searches, 0) AS searches, coalesce(successful, 0) AS successful FROM f LEFT JOIN c USING (day))
SELECT *, {PCT.format('acted', 'searched')} AS acted_rate, {PCT.format('successful', 'searches')} AS success_rate FROM j""")
def event_funnel(t):
    return ev.funnel(log(t), KINDS())


@query(f"""
SELECT day, user_id, search_no, bool_or(event_type IN ('purchase', 'signup')) AS successful,
       bool_or(event_type = 'click') AS opened, count(*) FILTER (event_type = 'purchase') AS actions,
       count(*) AS n_events
FROM ({NUMBERED}) WHERE search_no > 0 GROUP BY day, user_id, search_no""")
def event_attribution(t):
    return ev.attribute(log(t), KINDS(), [F.count(F.lit(1)).alias("n_events")])


DAILY = f"SELECT day, event_type, count(*) AS n, CAST(sum({CENTS.format('value')}) AS BIGINT) AS cents, count(DISTINCT user_id) AS users FROM ({LOG}) GROUP BY ALL"


def daily(t):
    return log(t).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("value"))).alias("cents"), F.count_distinct("user_id").alias("users"))


@query(DAILY)
def event_daily_summary(t):
    return daily(t)


@query(f"SELECT event_type, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(users) AS BIGINT) AS user_days FROM ({DAILY}) GROUP BY event_type")
def event_merge_days(t):
    return daily(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("users").alias("user_days"))


FACET = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"""
WITH e AS (SELECT {FACET} AS k, event_type FROM events),
x AS (SELECT unnest(['decile:' || CAST(k // 10 AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END]) AS facet, event_type FROM e),
c AS (SELECT facet, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_zero FROM x GROUP BY facet)
SELECT *, row_number() OVER (ORDER BY n DESC, facet) AS rank FROM c""")
def event_facets(t):
    k = F.get_json_object("props", "$.k").cast("long")
    facets = F.array(F.concat(F.lit("decile:"), F.floor(k / 10).cast("string")), F.when(k % 2 == 0, "even").otherwise("odd"))
    counts = t.events.select(F.explode(facets).alias("facet"), "event_type").groupBy("facet").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_zero"))
    return ev.ranked(counts, "n", ["facet"])


@query(f"SELECT event_type || ':' || CASE WHEN {FACET} = 0 THEN 'zero' WHEN {FACET} <= 5 THEN 'few' ELSE 'many' END AS key, count(*) AS n FROM events GROUP BY 1")
def result_bands(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy(F.concat_ws(":", "event_type", band(k)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions, count(*) FILTER (ok) AS after_search,
       {PCT.format('count(*) FILTER (ok)', 'count(*)')} AS share
FROM (SELECT *, search_no > 0 AS ok FROM ({NUMBERED})) GROUP BY event_type""")
def event_kinds_after_search(t):
    numbered = ev.with_search_number(log(t), KINDS())
    after = F.col("search_no") > 0
    grouped = numbered.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("sessions"), F.count_if(after).alias("after_search"))
    return grouped.withColumn("share", percent(F.col("after_search"), F.col("n")))


@query(f"SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY event_id) <= 30 AS accepted FROM ({LOG})")
def daily_cap(t):
    return ev.daily_cap(log(t).select("event_id", "day"), "day", ["event_id"], 30)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 89")
def event_sanitise(t):
    fine = ev.sanitise(t.events, "props", {"k": "BIGINT"}, ["k"], {"range": F.col("event.k").between(0, 89)})
    return fine.select("event_id", F.col("event.k").alias("k"))


BINS = "CASE WHEN value <= 5 THEN 0 WHEN value <= 10 THEN 1 WHEN value <= 25 THEN 2 WHEN value <= 50 THEN 3 WHEN value <= 75 THEN 4 WHEN value <= 100 THEN 5 WHEN value <= 150 THEN 6 WHEN value <= 200 THEN 7 WHEN value <= 250 THEN 8 ELSE 9 END"
HOURLY = f"""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type AS endpoint, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures,
       CAST(sum({CENTS.format('value')}) AS BIGINT) AS total_cs, {', '.join(f'count(*) FILTER ({BINS} = {i}) AS b{i}' for i in range(10))} FROM events GROUP BY 1, 2"""


@query(HOURLY)
def hourly_rollup(t):
    hour = F.date_trunc("hour", "ts")
    out = tm.rollup(t.events, hour, F.col("event_type"), F.col("value"), F.col("event_type") == "error")
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT event_type, CAST({BINS} AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def latency_histogram(t):
    return t.events.groupBy("event_type", bin_of(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH b AS (SELECT event_type, CAST({BINS} AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY event_type) AS total,
      [5, 10, 25, 50, 75, 100, 150, 200, 250, 250][bin + 1] AS upper FROM b)
SELECT event_type, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'CAST(min(upper) FILTER (upto >= ceil(total * {f}::DOUBLE)) AS BIGINT) AS p{p}' for f, p in ((0.5, 50), (0.95, 95), (0.99, 99)))} FROM c GROUP BY event_type""")
def histogram_percentile(t):
    return tm.histogram_percentiles(latency_histogram(t), ["event_type"], "bin", "n", [0.5, 0.95, 0.99])


@query(f"""
WITH r AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, max(n) AS n, {', '.join(f'max(value) FILTER (i = least(n - 1, CAST(floor(n * {f}::DOUBLE) AS BIGINT))) AS p{p}' for f, p in ((0.5, 50), (0.95, 95)))} FROM k GROUP BY event_type""")
def nearest_rank_percentile(t):
    return tm.nearest_rank(t.events, ["event_type"], "value", [F.desc("event_id")], 500, [0.5, 0.95])


@query("""
WITH g AS (SELECT w.range AS weekday, h.range AS hour FROM range(7) w, range(24) h),
c AS (SELECT isodow(ts + INTERVAL 3 HOUR) - 1 AS weekday, hour(ts + INTERVAL 3 HOUR) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(g.weekday AS INTEGER) AS weekday, CAST(g.hour AS INTEGER) AS hour, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.weekday = c.weekday AND g.hour = c.hour""")
def heatmap_weekday_hour(t):
    grid = t.spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = t.events.groupBy(local_weekday(F.col("ts")).alias("weekday"), local_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["weekday", "hour"], "left").fillna(0, ["n"])


@query(f"""
WITH p AS (SELECT event_type, {CENTS.format('value')} AS c, CASE WHEN ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-31' THEN 'now'
       WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-16' THEN 'before' END AS p FROM events),
s AS (SELECT event_type, CAST(count(*) FILTER (p = 'now') AS BIGINT) AS n_now, CAST(count(*) FILTER (p = 'before') AS BIGINT) AS n_before,
      CAST(coalesce(sum(c) FILTER (p = 'now'), 0) AS BIGINT) AS cents_now, CAST(coalesce(sum(c) FILTER (p = 'before'), 0) AS BIGINT) AS cents_before FROM p WHERE p IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN n_before <> 0 THEN floor((n_now - n_before) * 1000.0::DOUBLE / n_before + 0.5) / 10.0::DOUBLE END AS n_change,
       CASE WHEN cents_before <> 0 THEN floor((cents_now - cents_before) * 1000.0::DOUBLE / cents_before + 0.5) / 10.0::DOUBLE END AS cents_change FROM s""")
def period_compare(t):
    ts = F.col("ts")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    period = F.when((ts >= at("2024-01-16")) & (ts < at("2024-01-31")), "now").when((ts >= at("2024-01-01")) & (ts < at("2024-01-16")), "before")
    return tm.compare(t.events, ["event_type"], period, {"n": F.lit(1), "cents": cents(F.col("value"))})


@query(f"""
WITH c AS (SELECT day, hour(ts + INTERVAL 3 HOUR) AS hour, count(*) AS n FROM ({LOG}) GROUP BY 1, 2)
SELECT day, CAST(hour AS INTEGER) AS hour, n FROM c QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, hour) = 1""")
def peak_hour(t):
    counts = log(t).groupBy("day", local_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return tm.peak(counts, "n", "hour", ["day"])


@query("""
WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders),
d AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b),
c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.day = c.day""")
def dense_series(t):
    day = F.to_date("o_orderdate")
    starts = t.orders.agg(F.min(day).alias("a"), F.max(day).alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))
    counts = t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return dense(counts, "day", starts, {"n": 0}).withColumn("day", F.col("day").cast("string"))


FIRST = "SELECT o_custkey, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS month FROM orders GROUP BY o_custkey"


@query(f"""
WITH f AS ({FIRST}), o AS (SELECT count(*) AS opening FROM f WHERE month < DATE '1996-01-01'),
c AS (SELECT month, count(*) AS n FROM f WHERE month >= DATE '1996-01-01' GROUP BY month)
SELECT CAST(month AS VARCHAR) AS month, n, CAST(opening + sum(n) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM c, o""")
def running_total(t):
    first = t.orders.groupBy("o_custkey").agg(F.to_date(F.date_trunc("month", F.min("o_orderdate"))).alias("month"))
    since = F.lit("1996-01-01").cast("date")
    opening = first.agg(F.count_if(F.col("month") < since).alias("opening"))
    counts = first.where(F.col("month") >= since).groupBy("month").agg(F.count(F.lit(1)).alias("n")).crossJoin(opening)
    return tm.running_total(counts, "month", "n", F.col("opening")).select(F.col("month").cast("string").alias("month"), "n", "total")


@query(f"""
WITH a AS (SELECT DISTINCT user_id, CAST(day AS DATE) AS d FROM ({LOG})), m AS (SELECT DATE '2024-01-30' AS z)
SELECT count(DISTINCT user_id) FILTER (z - d BETWEEN 0 AND 0) AS dau, count(DISTINCT user_id) FILTER (z - d BETWEEN 0 AND 6) AS wau,
       count(DISTINCT user_id) FILTER (z - d BETWEEN 0 AND 29) AS mau FROM a, m""")
def active_users_dau_wau_mau(t):
    activity = log(t).select("user_id", F.col("day").cast("date").alias("day")).distinct()
    return tm.active_users(activity, "user_id", "day", F.lit("2024-01-30").cast("date"), {"dau": 1, "wau": 7, "mau": 30})


@query("""
SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def grouping_sets_status(t):
    grouped = t.orders.groupingSets([[], ["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("""
WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM c ORDER BY rank LIMIT 15""")
def ranked_topk(t):
    counts = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "user_id").limit(15)  # keeps 15 rows a task before any shuffle
    return ev.ranked(top, "n", ["user_id"])


@query("""
WITH c AS (SELECT user_id, event_id, ts, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY user_id // 10 ORDER BY event_id) AS BIGINT) % 5000 AS counter FROM events)
SELECT event_id, counter, greatest(coalesce(counter - lag(counter) OVER (PARTITION BY user_id // 10 ORDER BY event_id), 0), 0) AS delta FROM c""")
def counter_delta(t):
    group = F.floor(F.col("user_id") / 10)
    counter = F.sum(cents(F.col("value"))).over(Window.partitionBy("g").orderBy("event_id")) % 5000
    rows = t.events.withColumn("g", group).select("event_id", "g", counter.alias("counter"))
    return tm.positive_deltas(rows, ["g"], "event_id", "counter").drop("g")


@query("""
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events),
w AS (SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS BIGINT) AS cost_in_span FROM e)
SELECT *, cost_in_span > 7200.0 AS over FROM w""")
def sliding_cost_share(t):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = t.events.select("event_id", "user_id", seconds.alias("s"), cents(F.col("value")).alias("c"))
    return tm.sliding_share(rows, ["user_id"], "s", "c", 7200, 1.0).select("event_id", "cost_in_span", "over")


@query(f"""
WITH e AS (SELECT event_id, user_id, day FROM ({LOG})), s AS (SELECT day, user_id, min(event_id) AS f FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY f, user_id) AS turn FROM s)
SELECT r.day, CASE WHEN turn <= 5 THEN CAST(r.user_id AS VARCHAR) ELSE 'unknown' END AS key, count(*) AS n FROM e JOIN r USING (day, user_id) GROUP BY 1, 2""")
def key_cap_overflow(t):
    rows = log(t).select("event_id", "day", F.col("user_id").cast("string").alias("user_id"))
    return tm.key_cap(rows, "day", "user_id", "event_id", 5).groupBy("day", F.col("capped").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS sent, count(*) FILTER (o_orderstatus = 'P') AS pending,
       count(*) FILTER (o_orderstatus = 'O') AS failed,
       CASE WHEN count(*) <> 0 THEN floor(count(*) FILTER (o_orderstatus = 'F') * 1000.0::DOUBLE / count(*) + 0.5) / 10.0::DOUBLE END AS delivery_rate,
       CASE WHEN sum(count(*)) OVER () <> 0 THEN floor(count(*) * 1000.0::DOUBLE / CAST(sum(count(*)) OVER () AS BIGINT) + 0.5) / 10.0::DOUBLE END AS share
FROM orders GROUP BY o_orderpriority""")
def outcome_by_kind(t):
    status = F.col("o_orderstatus")
    out = t.orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(status == s).alias(n) for s, n in (("F", "sent"), ("P", "pending"), ("O", "failed"))])
    return out.withColumns({"delivery_rate": percent(F.col("sent"), F.col("n")), "share": percent(F.col("n"), F.sum("n").over(Window.partitionBy()))})


@query("""
WITH l AS (SELECT o_orderpriority, greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0) AS lead
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS n, floor(CAST(sum(lead) AS BIGINT) * 10.0::DOUBLE / count(*) + 0.5) / 10.0::DOUBLE AS lead_days FROM l GROUP BY 1""")
def lead_time_average(t):
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    lead = F.greatest(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")), F.lit(0)).cast("long")
    out = joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(lead).alias("s"))
    return out.select("o_orderpriority", "n", (F.floor(F.col("s") * F.lit(10.0) / F.col("n") + 0.5) / F.lit(10.0)).alias("lead_days"))


@query("""
SELECT c_custkey, count(o_orderkey) AS n, CAST(max(o_orderdate) AS VARCHAR) AS last FROM customer JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey HAVING max(o_orderdate) < TIMESTAMP '2001-01-01'""")
def having_inactive(t):
    grouped = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("m"))
    return grouped.where(F.col("m") < F.lit("2001-01-01").cast("timestamp_ntz")).select("c_custkey", "n", F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("last"))
