"""Pages and people, limits and statistics, keyed tables and calendars."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timeops as ti
from ..functions.numbers import half_up
from ..operators import etl
from ..operators import telemetry as tm
from ..sources import tables as tb
from .registry import Tables, query
from .texts import _html_sql

PAGE_TEXT = f"SELECT page_id, url, {_html_sql('html')} AS x FROM pages"
FOLD = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
WORDS = "string_split(trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


def people(t: Tables):
    """A person for each page: two of its words, the second from the page before on every third page; every seventh address is no web address."""
    words = F.split(tx.words_only(etl.html_text(F.col("html"))), " ")
    named = t.pages.select("page_id", "url", F.get(words, 4).alias("surname"), F.get(words, 5).alias("own"))
    before = named.select((F.col("page_id") + 1).alias("page_id"), F.col("own").alias("other"))
    first = F.when(F.col("page_id") % 3 == 0, F.concat(F.coalesce("other", F.lit("")), F.lit("q"))).otherwise(F.col("own"))
    return named.join(before, "page_id", "left").select("page_id", F.when(F.col("page_id") % 7 == 6, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("url"), "surname", first.alias("first"))


PEOPLE = f"""SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'ftp:' || url ELSE url END AS url, surname, CASE WHEN page_id % 3 = 0 THEN coalesce(lag(own) OVER (ORDER BY page_id), '') || 'q' ELSE own END AS first
 FROM (SELECT page_id, url, {WORDS}[5] AS surname, {WORDS}[6] AS own FROM ({PAGE_TEXT}))"""
HOLDS = f"(contains({FOLD.format('x')}, ' ' || surname || ' ' || first) OR contains({FOLD.format('x')}, ' ' || first || ' ' || surname || ' ') OR contains({FOLD.format('x')}, ' ' || surname || ' ' || substr(first, 1, 1) || ' '))"


@query(f"SELECT p.page_id, coalesce(surname <> '' AND first <> '' AND {HOLDS}, false) AS found FROM ({PEOPLE}) p JOIN ({PAGE_TEXT}) t ON p.page_id = t.page_id")
def person_on_page(t):
    texts = t.pages.select("page_id", etl.html_text(F.col("html")).alias("x"))
    return people(t).join(texts, "page_id").select("page_id", etl.person_on_page(F.col("x"), F.col("surname"), F.col("first")).alias("found"))


@query(f"""
WITH p AS (SELECT * FROM ({PEOPLE}) WHERE regexp_matches(url, '^https?://')), t AS (SELECT * FROM ({PAGE_TEXT}) WHERE page_id % 5 <> 4),
m AS (SELECT p.page_id, CASE WHEN coalesce(x, '') = '' THEN 0 WHEN coalesce(surname <> '' AND first <> '' AND {HOLDS}, false) THEN 2 ELSE 1 END AS s FROM p LEFT JOIN t ON p.url = t.url)
SELECT page_id, CASE max(s) WHEN 0 THEN 'unreachable' WHEN 1 THEN 'missing' ELSE 'present' END AS status FROM m GROUP BY page_id""")
def verify_people(t):
    return etl.verify_on_pages(people(t), t.pages.where("page_id % 5 <> 4"), "page_id", "url", "html", "surname", "first")


@query(r"""
WITH c AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<a\b')) AS people, len(regexp_extract_all(html, '[0-9]+')) AS prices, len(regexp_extract_all(html, '(?i)<li\b')) AS unmatched, contains(html, '<article') AS place FROM pages)
SELECT page_id, CASE WHEN people > 6 OR prices > 40 OR unmatched > 12 THEN 'too_many_records' WHEN NOT place AND people = 0 AND prices = 0 THEN 'parse_empty' ELSE 'ok' END AS state FROM c""")
def parse_guard(t):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return t.pages.select("page_id", etl.parse_guard(n(r"(?i)<a\b"), n("[0-9]+"), n(r"(?i)<li\b"), F.contains("html", F.lit("<article")), 6, 40, 12).alias("state"))


@query("""
WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN (contains(k, 'bolt') OR contains(k, 'widget')) AND NOT contains(k, 'cold') THEN ['bolt', 'w idget'] ELSE [] END, CASE WHEN contains(k, 'promo') OR contains(k, 'ringlarge') THEN ['promo', 'ring large'] ELSE [] END))), '|') AS aliases FROM n""")
def alias_by_containment(t):
    found = etl.aliases(F.concat_ws(" ", "p_name", "p_type"), {"bolt": ["w idget"], "promo": ["ring large"]}, {"bolt": ["cold"]})
    return t.part.select("p_partkey", F.array_join(found, "|").alias("aliases"))


ROW_HTML = "'<table><tr><th>Name</th><th>Price</th></tr><tr><td>' || p_name || '</td><td>from</td><td><b>' || {0} || '</b> EUR</td></tr><tr><td>' || p_brand || '</td><td>ask</td></tr></table>'"


def priced_pages(t: Tables):
    price = F.floor("p_retailprice").cast("long").cast("string")
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Price</th></tr><tr><td>"), "p_name", F.lit("</td><td>from</td><td><b>"), price, F.lit("</b> EUR</td></tr><tr><td>"), "p_brand", F.lit("</td><td>ask</td></tr></table>"))
    return t.part.select("p_partkey", html.alias("html"))


@query("""
SELECT p_partkey, 0 AS "row", 'Name|Price' AS cells FROM part UNION ALL SELECT p_partkey, 1, p_name || '|from|' || CAST(floor(p_retailprice) AS BIGINT) || ' EUR' FROM part UNION ALL SELECT p_partkey, 2, p_brand || '|ask' FROM part""")
def table_cells(t):
    return etl.table_rows(priced_pages(t), ["p_partkey"], "html").select("p_partkey", "row", F.array_join("cells", "|").alias("cells"))


@query("SELECT p_partkey, p_name AS name, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part")
def price_rows(t):
    return etl.price_rows(etl.table_rows(priced_pages(t), ["p_partkey"], "html"), ["p_partkey"])


@query("""
SELECT s_suppkey, s_name AS name, CAST(s_nationkey AS INTEGER) AS floor FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT s_suppkey, 'Dr ' || s_suppkey, CAST(NULL AS INTEGER) FROM supplier WHERE s_suppkey % 3 = 1""")
def json_ld_items(t):
    name = F.col("s_name")
    one = F.to_json(F.struct(name.alias("name"), F.col("s_nationkey").alias("floor")))
    doctor = F.to_json(F.struct(F.concat(F.lit("Dr "), F.col("s_suppkey").cast("string")).alias("name")))
    body = F.when(F.col("s_suppkey") % 3 == 0, one).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('{"@graph": ['), one, F.lit(","), doctor, F.lit("]}"))).otherwise("broken {")
    pages = t.supplier.select("s_suppkey", F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>")).alias("html"))
    return etl.json_ld(pages, ["s_suppkey"], "html", "struct<name:string,floor:int>").select("s_suppkey", "item.name", "item.floor").where("name IS NOT NULL")


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN regexp_replace(c_name, '\\s*Ltd$', '') END), ''), c_mktsegment) AS name FROM customer")
def canonical_record(t):
    key = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.concat("c_name", F.lit(" Ltd"))).alias("title"), "c_mktsegment")
    return rows.select("c_custkey", tb.fill_from(["title", "c_mktsegment"], "Ltd").alias("name"))


@query("""
WITH b AS (SELECT p_partkey AS k, p_size AS n, 'old' AS tag FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT p_partkey AS k, p_size + 1 AS n, 'new' AS tag FROM part WHERE p_partkey % 2 = 0)
SELECT k, CAST(n AS INTEGER) AS n, tag FROM a UNION ALL SELECT k, CAST(n AS INTEGER), tag FROM b WHERE k NOT IN (SELECT k FROM a)""")
def upsert_replace(t):
    b = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), F.lit("old").alias("tag"))
    a = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 1).alias("n"), F.lit("new").alias("tag"))
    return tb.replace_rows(b, a, ["k"])


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-09'")
def retention_delete(t):
    return tb.retain(t.events, F.to_date("ts"), F.lit("2024-01-09").cast("date")).select("event_id")


STATUS = "CASE WHEN event_id % 17 = 0 THEN 429 WHEN event_type = 'error' THEN 500 + event_id % 3 WHEN event_type = 'click' THEN 302 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END"


def status():
    i = F.col("event_id")
    return F.when(i % 17 == 0, 429).when(F.col("event_type") == "error", 500 + i % 3).when(F.col("event_type") == "click", 302).when(i % 11 == 0, 404).otherwise(200)


@query(f"""
WITH r AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS endpoint, {STATUS} AS s, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cs FROM events)
SELECT hour, endpoint, count(*) AS n, count(*) FILTER (s BETWEEN 200 AND 299) AS s2xx, count(*) FILTER (s BETWEEN 300 AND 399) AS s3xx, count(*) FILTER (s BETWEEN 400 AND 499 AND s <> 429) AS s4xx, count(*) FILTER (s >= 500) AS s5xx, count(*) FILTER (s = 429) AS s429,
 CAST(sum(cs) AS BIGINT) AS total, CAST(floor(sum(cs) * 1.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS average FROM r GROUP BY 1, 2""")
def status_rollup(t):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    return tm.status_rollup(t.events, hour, F.col("event_type"), status(), half_up(F.col("value") * 100).cast("long"))


@query("""
WITH n AS (SELECT date_trunc('hour', max(ts)) AS h FROM events), e AS (SELECT CAST(date_diff('hour', date_trunc('hour', ts), h) AS INTEGER) AS ago, event_type = 'error' AS f FROM events, n)
SELECT CAST(i AS INTEGER) AS hours_ago, count(ago) AS n, count(*) FILTER (f) AS failures FROM (SELECT unnest(range(24)) AS i) LEFT JOIN e ON ago = i GROUP BY i""")
def last_day_by_hour(t):
    now = t.events.agg(F.max("ts").alias("now")).first()["now"]
    return tm.last_hours(t.events, F.col("ts"), F.col("event_type") == "error", F.lit(now))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'cards' WHEN 'purchase' THEN 'booking' ELSE 'other' END AS grp FROM events")
def route_groups(t):
    path = F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    return t.events.select("event_id", tx.first_match(path, [("^/api/view/", "search"), ("^/api/(click|open)/", "cards"), ("^/api/purchase", "booking")], "other").alias("grp"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '10.0.' || c_custkey % 7 || '.1' WHEN c_custkey % 3 = 1 THEN '2001:db8:' || printf('%x', c_custkey % 500) || ':0::/64' ELSE '2001:db8:0:0::/64' END AS key FROM customer""")
def address_keys(t):
    i = F.col("c_custkey")
    v6 = F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex(i % 500), 4, "0"), F.lit(":0000:1:2:3:"), F.hex(i))
    ip = F.when(i % 3 == 0, F.concat(F.lit("10.0."), (i % 7).cast("string"), F.lit(".1"))).when(i % 3 == 1, v6).otherwise("2001:db8::" )
    return t.customer.select("c_custkey", tx.address_key(ip).alias("key"))


NOW = datetime(2024, 5, 15, 10, 30)
PRESET_NAMES = ["today", "yesterday", "7d", "30d", "90d", "week", "month", "prev_month", "year"]


@query("""
WITH n AS (SELECT max(ts) AS now, date_trunc('day', max(ts)) AS day FROM events),
p AS (SELECT unnest(['today', 'yesterday', '7d', '30d', '90d', 'week', 'month', 'prev_month', 'year']) AS preset,
 unnest([day, day - INTERVAL 1 DAY, day - INTERVAL 6 DAY, day - INTERVAL 29 DAY, day - INTERVAL 89 DAY, date_trunc('week', now), date_trunc('month', now), date_trunc('month', now) - INTERVAL 1 MONTH, date_trunc('year', now)]) AS a,
 unnest([now, day, now, now, now, now, now, date_trunc('month', now), now]) AS b FROM n)
SELECT preset, CASE WHEN epoch(b - a) <= 2 * 86400 THEN 'hour' WHEN epoch(b - a) <= 92 * 86400 THEN 'day' WHEN epoch(b - a) <= 400 * 86400 THEN 'week' ELSE 'month' END AS bucket,
 (SELECT count(*) FROM events WHERE ts >= a AND ts < b) AS n, (SELECT count(*) FROM events WHERE ts >= a - (b - a) AND ts < a) AS n_before FROM p""")
def period_presets(t):
    """Events of every preset period up to the last event, and of the period before it, in one pass of conditional counts."""
    now = t.events.agg(F.max("ts")).first()[0]
    spans = {p: ti.period(p, now) for p in PRESET_NAMES}
    at = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    inside = lambda p: F.count_if((F.col("ts") >= at(p.start)) & (F.col("ts") < at(p.end)))
    counts = t.events.agg(*[inside(p).alias(f"n{i}") for i, p in enumerate(spans.values())], *[inside(p.previous).alias(f"b{i}") for i, p in enumerate(spans.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("preset"), F.lit(p.bucket).alias("bucket"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("n_before")) for i, (name, p) in enumerate(spans.items())])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


@query("""
WITH t AS (SELECT min(o_orderdate)::DATE AS today FROM orders), d AS (SELECT CAST(today + CAST(i AS INTEGER) AS DATE) AS day, today, i FROM t, (SELECT unnest(range(14)) AS i)), w AS (SELECT day, i, CAST(isodow(day) AS INTEGER) AS weekday, 7 - isodow(today) AS left FROM d),
a AS (SELECT 'weekend' AS asked, day, weekday FROM w WHERE weekday >= 6 UNION ALL SELECT 'next_week', day, weekday FROM w WHERE i > w.left AND i <= w.left + 7
UNION ALL SELECT 'this_week', day, weekday FROM w WHERE i <= w.left UNION ALL SELECT 'not_tue', day, weekday FROM w WHERE weekday <= 5 AND weekday <> 2)
SELECT asked, CAST(day AS VARCHAR) AS day, weekday, count(o_orderkey) AS orders FROM a LEFT JOIN orders ON o_orderdate::DATE = day GROUP BY 1, 2, 3""")
def symbolic_days(t):
    """Orders on the days that symbols name, in the fortnight from the first order."""
    today = t.orders.agg(F.min(F.to_date("o_orderdate"))).first()[0]
    asked = {"weekend": (["weekend"], None), "next_week": (["next_week"], None), "this_week": (["this_week"], None), "not_tue": (["workday"], ["tue"])}
    out = None
    for name, (only, not_on) in asked.items():
        days = ti.resolve_days(t.spark, today, 14, only, not_on).select(F.lit(name).alias("asked"), "day", "weekday")
        out = days if out is None else out.unionByName(days)
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    joined = out.join(per_day, "day", "left")
    return joined.select("asked", F.col("day").cast("string").alias("day"), "weekday", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS leaked FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ()))
SELECT CASE WHEN c_nationkey IS NOT NULL THEN 'nation' WHEN c_mktsegment IS NOT NULL THEN 'segment' ELSE 'all' END AS kind, coalesce(CAST(c_nationkey AS VARCHAR), c_mktsegment, 'all') AS key, n, leaked, floor(leaked * 1000.0::DOUBLE / n + 0.5) / 10.0::DOUBLE AS rate FROM g""")
def evaluation_summary(t):
    """Leak rates per category, per origin and in all, in one pass."""
    from ..operators.privacy import rates

    return rates(t.customer, {"nation": F.col("c_nationkey").cast("string"), "segment": F.col("c_mktsegment")}, {"leaked": F.col("c_acctbal") < 0})


@query(f"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(substr(text, 1, 5000), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'))) AS digest FROM documents""")
def clean_text(t):
    """Control characters out, blanks collapsed, at most 5,000 characters: the cut is the feature."""
    return t.documents.select("doc_id", F.md5(etl.cleaned(F.col("text"), 5000)).alias("digest"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def log_roundtrip(t):
    """Events appended to a day-partitioned log of JSON lines and read back."""
    from ..operators.graph import shared_folder
    from ..sources import logs

    path = shared_folder(t.spark, "log")
    logs.append_days(t.events, path, ["event_id"], 1_000_000)
    return logs.read_days(t.spark, path, "event_id long, user_id long, day date").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, event_id % 3 AS part FROM events),
h AS (SELECT *, count(*) OVER (PARTITION BY day, part) AS n FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY day, part ORDER BY event_id) AS turn FROM h),
c AS (SELECT day, coalesce(max(n) FILTER (part = 0), 0) AS a, coalesce(max(n) FILTER (part = 1), 0) AS b FROM r GROUP BY day),
k AS (SELECT r.*, CASE part WHEN 0 THEN 0 WHEN 1 THEN least(a, 20) ELSE least(a + b, 20) END AS before FROM r JOIN c USING (day))
SELECT day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, max(part) AS last_part FROM k WHERE before + turn <= 20 GROUP BY day""")
def log_appends(t):
    """Three appends to a log with a cap of twenty a day (the cap is the feature); the first two come twice and count once."""
    from ..operators.graph import shared_folder
    from ..sources import logs

    path = shared_folder(t.spark, "log")
    for part in (0, 0, 1, 1, 2):
        logs.append_days(t.events.where(F.col("event_id") % 3 == part), path, ["event_id"], 20, batch=str(part))
    kept = logs.read_days(t.spark, path, "event_id long, day date")
    return kept.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.max(F.col("event_id") % 3).alias("last_part"))
