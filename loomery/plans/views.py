"""Whole views: enriched cards, many facets and sort keys, audit search, dialogue state, de-identification, approved changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_km, straight_minutes
from ..functions.hours import evening_until, intervals, open_at
from ..operators import etl
from ..operators import privacy as pv
from ..operators import requests as rq
from ..operators import search as se
from .catalog import CARDS, cards
from .places import HOURS, KM, POINT, hours, point
from .records import changes
from .registry import Tables, query
from .texts import _re

OPEN = "EXISTS (SELECT 1 FROM ({0}) h WHERE h.s = k.s_suppkey AND ((x[1] <= {1} AND {1} < x[2]) OR (x[1] <= {1} + 1440 AND {1} + 1440 < x[2])))"


@query(f"""
WITH k AS (SELECT s_suppkey, s_acctbal, {POINT.format('s_suppkey')} FROM supplier), d AS (SELECT *, {KM.format('lat', 'lon', '50.5', '30.5')} AS km, s_suppkey % 11 = 0 AS unknown FROM k)
SELECT s_suppkey, CAST(floor(km * 1000 + 0.5) AS BIGINT) AS metres, CAST(greatest(floor(km * (1.3 * 60 / 28.0) + 0.5), 1) AS INTEGER) AS minutes, CASE WHEN NOT unknown THEN {OPEN.format(HOURS, 700)} END AS open,
 CASE WHEN NOT unknown THEN EXISTS (SELECT 1 FROM ({HOURS}) h WHERE h.s = k.s_suppkey AND x[2] >= 1200) END AS evening, CASE WHEN s_acctbal >= 8000 THEN 'top' WHEN s_acctbal >= 4000 THEN 'high' END AS badge, CASE WHEN s_suppkey % 3 = 0 THEN 'lab' ELSE 'clinic' END AS kind FROM d k""")
def card_enrichment(t):
    """Cards with distance, estimated minutes, open state, evening flag, the strongest badge and kind."""
    rows = t.supplier.select("s_suppkey", "s_acctbal", *point("s_suppkey")).join(hours(t), "s_suppkey")
    km, x = haversine_km(F.col("lat"), F.col("lon"), F.lit(50.5), F.lit(30.5)), intervals(F.col("hours"))
    badge = F.when(F.col("s_acctbal") >= 8000, "top").when(F.col("s_acctbal") >= 4000, "high")
    known = rows.select("s_suppkey", km.alias("km"), x.alias("x"), badge.alias("badge"), F.when(F.col("s_suppkey") % 3 == 0, "lab").otherwise("clinic").alias("kind"))
    return known.select("s_suppkey", F.floor(F.col("km") * 1000 + 0.5).cast("long").alias("metres"), straight_minutes(F.col("km"), "drive").alias("minutes"), open_at(F.col("x"), F.col("x"), F.lit(700)).alias("open"), evening_until(F.col("x")).alias("evening"), "badge", "kind")


FACETS = {
    "text": "contains(lower(district), 'nation_1')", "kind": "kind IN ('PROMO', 'LARGE', 'STANDARD')", "not_kind": "kind NOT IN ('LARGE')", "brand": "brand <> 'Brand#1'", "city": "city IN (0, 1, 2, 3)", "rating": "rating >= -500",
    "experience": "n >= 1", "distance": "CASE WHEN s % 4 = 0 THEN NULL ELSE s * 37 % 100 END IS NULL OR s * 37 % 100 <= 80", "price": "price <= 400000", "size": "size BETWEEN 2 AND 48", "online": "s % 5 <> 1", "access": "p % 6 <> 2", "children": "p % 7 <> 3", "weekend": "s % 8 <> 4", "evening": "s % 9 <> 5",
}


@query(f"SELECT s, p FROM ({CARDS}) WHERE ({' AND '.join(f'({x})' for x in FACETS.values())}) OR s % 50 = 7 AND p % 40 = 1")
def facets_all(t):
    """Fifteen facets at once; an unknown distance passes, and pinned cards always do."""
    return se.matching(cards(t), {k: F.expr(x) for k, x in FACETS.items()}, (F.col("s") % 50 == 7) & (F.col("p") % 40 == 1)).select("s", "p")


SORT = ["s % 50 = 7 DESC", "s % 5 <> 1 DESC", "kind = 'PROMO' DESC", "city", "rating DESC", "price", "n DESC", "size", "brand", "kind", "s", "p"]


@query(f"SELECT s, p, row_number() OVER (ORDER BY {', '.join(SORT)}) AS rank FROM ({CARDS}) ORDER BY rank LIMIT 100")
def twelve_keys(t):
    """The recommendation order by twelve keys; a page of a hundred."""
    keys = [F.desc(F.expr(k[:-5])) if k.endswith(" DESC") else F.asc(F.expr(k)) for k in SORT]
    return se.top(cards(t), keys, 100).select("s", "p", "rank")


@query("""
WITH f AS (SELECT event_id, ts FROM events WHERE event_type LIKE 'p%' AND user_id BETWEEN 10 AND 90 AND contains(props, '7') AND value < 90 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-02-20')
SELECT event_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10""")
def audit_search(t):
    """Every filter that an audit search may name, those asked for joined by and; the second page with the total."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    asked = {"prefix": "p", "action": None, "actor": (10, 90), "target": None, "text": "7", "most": 90, "since": "2024-01-02", "until": "2024-02-20"}
    known = {
        "prefix": lambda v: F.col("event_type").startswith(v), "action": lambda v: F.col("event_type") == v, "actor": lambda v: F.col("user_id").between(*v), "target": lambda v: F.get_json_object("props", "$.k") == v,
        "text": lambda v: F.contains("props", F.lit(v)), "most": lambda v: F.col("value") < v, "since": lambda v: F.col("ts") >= at(v), "until": lambda v: F.col("ts") < at(v),
    }
    found = se.matching(t.events, {k: known[k](v) for k, v in asked.items() if v is not None})
    return se.page(found.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 10, 1).select("event_id", "total")


@query("""
WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '-' WHEN role = 'user' THEN CAST(length(text) AS VARCHAR) END AS asked, CASE WHEN length(text) % 3 = 0 THEN '-' WHEN length(text) % 2 = 0 THEN role END AS who FROM conversations)
SELECT conv_id, nullif(arg_max(asked, turn) FILTER (asked IS NOT NULL), '-') AS asked, nullif(arg_max(who, turn) FILTER (who IS NOT NULL), '-') AS who, count(*) FILTER (asked = '-' OR who = '-') AS retracted FROM f GROUP BY conv_id""")
def turns_with_retractions(t):
    """What a dialogue has settled on: the last word on each condition, which may take it back."""
    asked = F.when(F.col("turn") % 4 == 3, "-").when(F.col("role") == "user", F.length("text").cast("string"))
    who = F.when(F.length("text") % 3 == 0, "-").when(F.length("text") % 2 == 0, F.col("role"))
    turns = t.conversations.select("conv_id", "turn", asked.alias("asked"), who.alias("who"))
    return rq.fold_with_retractions(turns, "conv_id", "turn", ["asked", "who"], "-")


CHAIN = ["iban", "card", "email", "email_spoken", "phone", "phone_local", "url", "ipv4", "mac", "uuid", "coordinates", "date", "date_dotted", "street"]
BLOCKED = ["passport", "social_number", "secret"]


def _chain_sql(column: str) -> str:
    for k in CHAIN:
        column = f"regexp_replace({column}, {_re(k)}, '[{k}]', 'g')"
    return column


@query(f"SELECT doc_id, b AS blocked, CASE WHEN NOT b THEN md5({_chain_sql('text')}) END AS digest FROM (SELECT doc_id, text, {' OR '.join(f'regexp_matches(text, {_re(k)})' for k in BLOCKED)} AS b FROM documents)")
def deidentified(t):
    """Replacements in a fixed order; a text with a number that names one person is held back whole."""
    text = F.col("text")
    return t.documents.select("doc_id", pv.deidentified(text, CHAIN, BLOCKED).alias("d")).select("doc_id", "d.blocked", F.md5("d.text").alias("digest"))


@query("""
WITH b AS (SELECT p_partkey, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price FROM part WHERE p_partkey % 10 <> 0),
a AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * 2 WHEN p_partkey % 3 = 0 THEN CAST(floor(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * 1.1::DOUBLE) AS BIGINT) ELSE CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) END AS price FROM part WHERE p_partkey % 11 <> 0)
SELECT b.p_partkey, CASE WHEN a.price IS NOT NULL AND abs(a.price - b.price) <= b.price * 0.2::DOUBLE THEN a.price ELSE b.price END AS price, b.price AS baseline, a.price IS NOT NULL AND a.price <> b.price AND abs(a.price - b.price) <= b.price * 0.2::DOUBLE AS changed FROM b LEFT JOIN a USING (p_partkey)""")
def approved_prices(t):
    """Prices that pass by themselves are taken over; the baseline, the last approved price, stays where it was."""
    from .catalog import snapshots

    before, _ = snapshots(t)
    base = before.select("p_partkey", "price", F.col("price").alias("baseline"))
    diff = changes(t).where("field = 'price'").join(base.select("p_partkey", "baseline"), "p_partkey")
    return etl.apply_prices(base, etl.triage(diff, F.col("baseline")), "p_partkey")
