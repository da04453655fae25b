"""Snapshots, ledgers, limits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cents
from ..operators import etl
from ..operators import joins as jn
from ..operators import ledger as lg
from .catalog import AFTER, BEFORE, DIFF, snapshots
from .registry import Tables, query


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) = 1")
def dedup_first(t):
    return jn.first_of(t.orders, ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def changes(t: Tables):
    return jn.keyed_diff(*snapshots(t), ["p_partkey"], ["p_brand", "p_size", "price"])


@query(f"SELECT change, field, count(*) AS n FROM ({DIFF}) GROUP BY change, field")
def snapshot_diff(t):
    return changes(t).groupBy("change", "field").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH d AS ({DIFF}), p AS (SELECT p_partkey AS k, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS base FROM part)
SELECT p_partkey, change, field, CASE WHEN change = 'changed' AND field = 'price' AND abs(TRY_CAST(after AS DOUBLE) - base) <= base * 0.2::DOUBLE THEN 'auto' ELSE 'review' END AS decision FROM d JOIN p ON p_partkey = k""")
def change_triage(t):
    approved = t.part.select("p_partkey", cents(F.col("p_retailprice")).alias("base"))
    return etl.triage(changes(t).join(approved, "p_partkey"), F.col("base")).select("p_partkey", "change", "field", "decision")


@query(f"""
WITH n AS (SELECT p_partkey % 20 AS g, count(*) AS n FROM ({BEFORE}) GROUP BY 1), c AS (SELECT p_partkey % 20 AS g, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'added') AS added FROM ({DIFF}) GROUP BY 1)
SELECT n.g, n, coalesce(removed, 0) AS removed, coalesce(added, 0) AS added, (coalesce(removed, 0) >= 3 AND coalesce(removed, 0) > n * 0.5) OR coalesce(added, 0) > greatest(n, 30) AS suspicious FROM n LEFT JOIN c USING (g)""")
def mass_change_guard(t):
    before, _ = snapshots(t)
    g = F.col("p_partkey") % 20
    return etl.mass_change(changes(t), [g.alias("g")], before.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n")))


@query(f"""
WITH b AS ({BEFORE}), a AS ({AFTER})
SELECT b.* FROM b WHERE p_partkey % 2 = 1 OR p_partkey NOT IN (SELECT p_partkey FROM a) AND p_partkey % 4 <> 0 UNION ALL SELECT * FROM a WHERE p_partkey % 2 = 0""")
def apply_changes(t):
    before, after = snapshots(t)
    accepted = after.where("p_partkey % 2 = 0").withColumn("deleted", F.lit(False))
    gone = before.join(after, "p_partkey", "left_anti").where("p_partkey % 4 = 0").withColumn("deleted", F.lit(True))
    return etl.apply_changes(before, accepted.unionByName(gone), ["p_partkey"])


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 50 = 7")
def changed_pages(t):
    before = t.pages.where("page_id % 50 <> 7").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    return etl.changed_pages(before, t.pages, "page_id", "html").select("page_id")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'past' WHEN l_discount = 0 AND l_tax = 0 THEN 'terms' END AS reason FROM lineitem""")
def external_validation(t):
    checks = {"quantity": F.col("l_quantity") > 45, "past": F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "terms": (F.col("l_discount") == 0) & (F.col("l_tax") == 0)}
    return etl.split_valid(t.lineitem, checks).select("l_orderkey", "l_linenumber", "reason")


@query("""
WITH m AS (SELECT p_partkey AS id FROM part WHERE p_brand <> 'Brand#3'), x AS (SELECT DISTINCT l_partkey + 3 AS external FROM lineitem)
SELECT external, CASE WHEN id IS NULL THEN 'unmapped' WHEN external IS NULL THEN 'stale' ELSE 'mapped' END AS state, id FROM x FULL JOIN m ON external = id""")
def mapping_reconciliation(t):
    """External ids against a mapping: those without one, and mappings that nothing uses any more."""
    m = t.part.where("p_brand <> 'Brand#3'").select(F.col("p_partkey").alias("id"))
    seen = t.lineitem.select((F.col("l_partkey") + 3).alias("external")).distinct()
    return jn.reconciled(seen, m, "external", "id")


@query("""
SELECT l_partkey AS external, CASE WHEN m.id IS NULL THEN 'unmapped' ELSE 'mapped' END AS state, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0) m ON l_partkey = m.id GROUP BY 1, 2""")
def mapping_reconciliation_whole(t):
    """How many lines each external id has, mapped or not."""
    m = t.part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("id"))
    joined = t.lineitem.select(F.col("l_partkey").alias("external")).join(m, F.col("external") == F.col("id"), "left")
    return joined.groupBy("external", F.when(F.col("id").isNull(), "unmapped").otherwise("mapped").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_brand, p_type, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS sizes, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY p_brand, p_type""")
def catalog_build(t):
    return etl.merge_records(t.part, ["p_brand", "p_type"], {"sizes": "p_size"}, {"first": "p_partkey"}).withColumn("sizes", F.array_join("sizes", ","))


CHAIN = """SELECT user_id, event_id, event_type || ':' || CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS VARCHAR) AS payload FROM events"""


def chain(t: Tables):
    payload = F.concat_ws(":", "event_type", cents(F.col("value")).cast("string"))
    return lg.build_chain(t.events.select("user_id", "event_id", payload.alias("payload")), "user_id", "event_id", "payload")


@query(f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({CHAIN})),
c AS (SELECT user_id, n, event_id, sha256('genesis:' || user_id) AS prev_hash, sha256(sha256('genesis:' || user_id) || '|' || payload) AS hash FROM r WHERE n = 1
 UNION ALL SELECT r.user_id, r.n, r.event_id, c.hash, sha256(c.hash || '|' || r.payload) FROM c JOIN r ON r.user_id = c.user_id AND r.n = c.n + 1)
SELECT user_id, event_id, CAST(n - 1 AS INTEGER) AS place, prev_hash, hash FROM c""")
def hash_chain_build(t):
    return chain(t).select("user_id", "event_id", "place", "prev_hash", "hash")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 97 = 5) AS broken FROM events GROUP BY user_id")
def hash_chain_verify(t):
    """Every 97th record is altered after the fact; exactly those break."""
    altered = chain(t).withColumn("payload", F.when(F.col("event_id") % 97 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return lg.verify_chain(altered, "user_id", "event_id", "payload")


PAIRS = [("view", "click"), ("view", "purchase"), ("click", "purchase"), ("signup", "view"), ("error", "view")]


@query(f"""
WITH l AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), p(before, event_type) AS (VALUES {', '.join(repr(x) for x in PAIRS)})
SELECT event_id, l.before IS NULL OR l.before = l.event_type OR p.before IS NOT NULL AS allowed FROM l LEFT JOIN p ON p.before = l.before AND p.event_type = l.event_type""")
def state_transitions(t):
    pairs = t.spark.createDataFrame(PAIRS, "before string, after string")
    return lg.transitions(t.events, "user_id", ["event_id"], "event_type", pairs).select("event_id", "allowed")


@query("SELECT event_id, count(*) OVER () AS total FROM events WHERE event_type LIKE 'p%' AND user_id % 3 = 1 AND contains(props, '7') ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_filter(t):
    from ..operators.search import page

    found = t.events.where(F.col("event_type").startswith("p") & (F.col("user_id") % 3 == 1) & F.contains("props", F.lit("7")))
    return page(found.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 20, 0).select("event_id", "total")


@query("SELECT user_id, event_type, event_id AS last_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def consent_state(t):
    return lg.current(t.events, ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", F.col("event_id").alias("last_id"))


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER w AS r, sum(length(text)) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn FROM c WHERE r = 1 OR s <= 1500""")
def history_budget(t):
    return lg.newest_within(t.conversations, ["conv_id"], "turn", F.length("text"), 1500).select("conv_id", "turn")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5 AS kept FROM events WHERE event_type = 'signup'")
def session_cap(t):
    return lg.capped(t.events.where("event_type = 'signup'"), ["user_id"], [F.desc("event_id")], 5).select("event_id", "kept")


@query("""
WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1),
s AS (SELECT *, sum(CASE WHEN day >= '2024-01-05' THEN bytes ELSE 0 END) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY day DESC) AS r, sum(bytes) OVER () AS total FROM d)
SELECT day, bytes, (day >= '2024-01-05' AND upto <= 5000) OR r = 1 AS kept FROM s""")
def retention_prune(t):
    daily = t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.length("props")).alias("bytes"))
    return lg.prune(daily, "day", "bytes", F.lit("2024-01-05"), 5000)


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN user_id END AS user_id FROM events")
def ownership_forgetting(t):
    return lg.forget(t.events, "user_id", F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "user_id")


def timed(t: Tables):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return t.events.select("event_id", "user_id", seconds.alias("at"), F.col("value").alias("cost"), (F.col("event_type") == "error").alias("failed"))


TIMED = "SELECT event_id AS i, user_id, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS BIGINT) AS sec, value AS cost, event_type = 'error' AS failed, event_type FROM events"


def _folded(key: str, first: str, row: str, step: str, seed: str) -> str:
    """SQL of a fold: rows (i, f) of each key in order of (sec, i); `step` makes a row from acc, the rows so far, and x[1], the next."""
    return f"""WITH t AS ({TIMED}), g AS (SELECT {key}, list([{row}] ORDER BY sec, i) AS l FROM t GROUP BY {key}),
f AS (SELECT list_reduce(list_prepend([{seed}], l), lambda acc, x: acc || [{step}]) AS f FROM g), u AS (SELECT unnest(f) AS x FROM f)
SELECT x.i AS event_id, {first} FROM u WHERE x.i >= 0"""


@query(_folded("user_id", "x.ok AS accepted", "{'i': i, 'sec': sec, 'ok': true}", "{'i': x[1].i, 'sec': x[1].sec, 'ok': len(list_filter(acc, lambda y: y.ok AND y.sec > x[1].sec - 86400)) < 2}", "{'i': CAST(-1 AS BIGINT), 'sec': CAST(-100000000 AS BIGINT), 'ok': false}"))
def sliding_window_limit(t):
    return lg.sliding_limit(timed(t), ["user_id"], "at", 86_400, 2, "event_id").select("event_id", "accepted")


_LEVEL = "least(60.0::DOUBLE, acc[-1].level + (x[1].sec - acc[-1].sec) * 0.0005::DOUBLE)"


@query(_folded("user_id", "x.ok AS accepted", "{'i': i, 'sec': sec, 'cost': cost, 'ok': true, 'level': 0.0::DOUBLE}", f"{{'i': x[1].i, 'sec': x[1].sec, 'cost': x[1].cost, 'ok': {_LEVEL} > 0, 'level': CASE WHEN {_LEVEL} > 0 THEN {_LEVEL} - x[1].cost ELSE {_LEVEL} END}}", "{'i': CAST(-1 AS BIGINT), 'sec': CAST(0 AS BIGINT), 'cost': 0.0::DOUBLE, 'ok': false, 'level': 60.0::DOUBLE}"))
def token_bucket_limit(t):
    return lg.token_bucket(timed(t), ["user_id"], "at", "cost", 60.0, 0.0005, "event_id").select("event_id", "accepted")


_HELD = "x[1].sec < acc[-1].lock"
_LOCKS = "CASE WHEN acc[-1].last IS NOT NULL AND x[1].sec - acc[-1].last > 1000000 THEN 0 ELSE acc[-1].locks END"
_FAILS = "list_filter(acc[-1].fails, lambda y: y > x[1].sec - 400000)"
_FULL = f"x[1].failed AND len({_FAILS}) + 1 >= 2"
_UNTIL = f"x[1].sec + least(600000, 60000 * CAST(pow(2, {_LOCKS}) AS BIGINT))"
_LOCK_ROW = "{{'i': {0}, 'sec': {1}, 'failed': {2}, 'locked': {3}, 'until': {4}, 'fails': {5}, 'lock': {6}, 'locks': {7}, 'last': {8}}}"


@query(_folded("user_id", "x.locked AS locked, x.until AS until", _LOCK_ROW.format("i", "sec", "failed", "false", "CAST(0 AS BIGINT)", "CAST([] AS BIGINT[])", "CAST(-1 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(NULL AS BIGINT)"), _LOCK_ROW.format(
    "x[1].i", "x[1].sec", "x[1].failed", _HELD, f"CASE WHEN {_HELD} THEN acc[-1].lock WHEN {_FULL} THEN {_UNTIL} ELSE 0 END",
    f"CASE WHEN {_HELD} THEN acc[-1].fails WHEN NOT x[1].failed OR {_FULL} THEN CAST([] AS BIGINT[]) ELSE list_append({_FAILS}, x[1].sec) END", f"CASE WHEN NOT ({_HELD}) AND {_FULL} THEN {_UNTIL} ELSE acc[-1].lock END",
    f"CASE WHEN {_HELD} THEN acc[-1].locks WHEN {_FULL} THEN {_LOCKS} + 1 ELSE {_LOCKS} END", f"CASE WHEN NOT ({_HELD}) AND {_FULL} THEN x[1].sec ELSE acc[-1].last END"), _LOCK_ROW.format("CAST(-1 AS BIGINT)", "CAST(0 AS BIGINT)", "false", "false", "CAST(0 AS BIGINT)", "CAST([] AS BIGINT[])", "CAST(-1 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(NULL AS BIGINT)")))
def lockout_counter(t):
    return lg.lockout(timed(t), ["user_id"], "at", "failed", 400_000, 2, 60_000, 600_000, 1_000_000, "event_id").select("event_id", "locked", "until")


_STATUS = "CASE WHEN acc[-1].status = 'HELD' AND acc[-1].until <= x[1].sec THEN 'FREE' ELSE acc[-1].status END"
_WHO = "CASE WHEN acc[-1].status = 'HELD' AND acc[-1].until <= x[1].sec THEN NULL ELSE acc[-1].who END"
_AHEAD = "2000000 > x[1].sec"
_TAKES = f"x[1].kind = 'hold' AND {_STATUS} = 'FREE' AND {_AHEAD}"
_LETS = f"x[1].kind = 'release' AND {_STATUS} = 'HELD' AND {_WHO} IS NOT DISTINCT FROM x[1].by"
_BOOKS = f"x[1].kind = 'book' AND {_STATUS} <> 'BOOKED' AND {_AHEAD} AND ({_STATUS} = 'FREE' OR {_WHO} IS NOT DISTINCT FROM x[1].by)"
_CANCELS = f"x[1].kind = 'cancel' AND {_STATUS} = 'BOOKED' AND acc[-1].key IS NOT DISTINCT FROM x[1].by"
_SLOT_ROW = "{{'i': {0}, 'sec': {1}, 'kind': {2}, 'by': {3}, 'result': {4}, 'status': {5}, 'who': {6}, 'until': {7}, 'key': {8}}}"
_KIND = "CASE event_type WHEN 'view' THEN 'hold' WHEN 'purchase' THEN 'book' WHEN 'error' THEN 'cancel' ELSE 'release' END"
_NONE = "CAST(NULL AS VARCHAR)"


@query(_folded("user_id", "x.result AS result", _SLOT_ROW.format("i", "sec", _KIND, "CAST(i % 3 AS VARCHAR)", "''", "'FREE'", _NONE, "CAST(0 AS BIGINT)", _NONE), _SLOT_ROW.format(
    "x[1].i", "x[1].sec", "x[1].kind", "x[1].by",
    f"CASE WHEN {_TAKES} THEN 'held' WHEN x[1].kind = 'hold' THEN 'taken' WHEN {_LETS} THEN 'released' WHEN x[1].kind = 'release' THEN 'not_held' WHEN {_BOOKS} THEN 'booked' WHEN x[1].kind = 'book' AND {_STATUS} = 'BOOKED' AND acc[-1].key IS NOT DISTINCT FROM x[1].by THEN 'booked' WHEN x[1].kind = 'book' THEN 'taken' WHEN {_CANCELS} THEN 'cancelled' ELSE 'nothing' END",
    f"CASE WHEN {_TAKES} THEN 'HELD' WHEN {_LETS} THEN 'FREE' WHEN {_BOOKS} THEN 'BOOKED' WHEN {_CANCELS} THEN CASE WHEN {_AHEAD} THEN 'FREE' ELSE 'CANCELLED' END ELSE {_STATUS} END",
    f"CASE WHEN {_TAKES} OR {_BOOKS} THEN x[1].by WHEN {_LETS} OR {_CANCELS} THEN NULL ELSE {_WHO} END", f"CASE WHEN {_TAKES} THEN x[1].sec + 50000 WHEN {_LETS} OR {_BOOKS} OR {_CANCELS} THEN 0 ELSE acc[-1].until END",
    f"CASE WHEN {_BOOKS} THEN x[1].by WHEN {_CANCELS} THEN NULL ELSE acc[-1].key END"), _SLOT_ROW.format("CAST(-1 AS BIGINT)", "CAST(0 AS BIGINT)", "''", _NONE, "''", "'FREE'", _NONE, "CAST(0 AS BIGINT)", _NONE)))
def slot_operations(t):
    """Every user's slot, worked on by three holders."""
    return lg.apply_slot_operations(slot_work(t.events), "slot", "at", 50_000, "event_id").select("event_id", "result")


def slot_work(events, key=None):
    """Events as operations on the slot of their user."""
    kind = F.when(F.col("event_type") == "view", "hold").when(F.col("event_type") == "purchase", "book").when(F.col("event_type") == "error", "cancel").otherwise("release")
    holder = (F.col("event_id") % 3).cast("string")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return events.select("event_id", F.col("user_id").alias("slot"), seconds.alias("at"), kind.alias("kind"), holder.alias("who"), (holder if key is None else key).alias("key"), F.lit(2_000_000).cast("long").alias("starts"))


_OWN = "acc[-1].s[x[1].side + 1]"
_GONE = f"{_OWN}.status = 'HELD' AND {_OWN}.until <= x[1].sec"
_NOW = f"CASE WHEN {_GONE} THEN 'FREE' ELSE {_OWN}.status END"
_BY = f"CASE WHEN {_GONE} THEN NULL ELSE {_OWN}.who END"
_USED = "list_filter(acc[-1].used, lambda u: u.key = x[1].key)"
_KEYED = f"""CASE x[1].kind WHEN 'hold' THEN CASE WHEN {_NOW} = 'FREE' AND {_AHEAD} THEN 'held' ELSE 'taken' END
 WHEN 'release' THEN CASE WHEN {_NOW} = 'HELD' AND {_BY} IS NOT DISTINCT FROM x[1].who THEN 'released' ELSE 'not_held' END
 WHEN 'book' THEN CASE WHEN len({_USED}) > 0 THEN CASE WHEN {_USED}[1].side = x[1].side THEN 'repeated' ELSE 'conflict' END WHEN {_NOW} <> 'BOOKED' AND {_AHEAD} AND ({_NOW} = 'FREE' OR {_BY} IS NOT DISTINCT FROM x[1].who) THEN 'booked' ELSE 'taken' END
 ELSE CASE WHEN {_NOW} = 'BOOKED' AND {_OWN}.key IS NOT DISTINCT FROM x[1].key THEN 'cancelled' ELSE 'nothing' END END"""
_ONE_SLOT = "{{'status': {0}, 'who': {1}, 'until': {2}, 'key': {3}}}"
_NEXT = f"""CASE {_KEYED} WHEN 'held' THEN {_ONE_SLOT.format("'HELD'", "x[1].who", "x[1].sec + 50000", f"{_OWN}.key")} WHEN 'released' THEN {_ONE_SLOT.format("'FREE'", _NONE, "CAST(0 AS BIGINT)", f"{_OWN}.key")}
 WHEN 'booked' THEN {_ONE_SLOT.format("'BOOKED'", "x[1].who", "CAST(0 AS BIGINT)", "x[1].key")} WHEN 'cancelled' THEN {_ONE_SLOT.format(f"CASE WHEN {_AHEAD} THEN 'FREE' ELSE 'CANCELLED' END", _NONE, "CAST(0 AS BIGINT)", _NONE)} ELSE {_ONE_SLOT.format(_NOW, _BY, f"{_OWN}.until", f"{_OWN}.key")} END"""
_FREE_SLOT = _ONE_SLOT.format("'FREE'", _NONE, "CAST(0 AS BIGINT)", _NONE)
_KEY_ROW = "{{'i': {0}, 'sec': {1}, 'kind': {2}, 'side': {3}, 'who': {4}, 'key': {5}, 'result': {6}, 's': {7}, 'used': {8}}}"
_NO_KEYS = "list_filter([{'key': '', 'side': CAST(0 AS BIGINT)}], lambda u: u.key <> '')"


@query(_folded("user_id // 2", "x.result AS result", _KEY_ROW.format("i", "sec", _KIND, "CAST(user_id % 2 AS BIGINT)", "CAST(i % 3 AS VARCHAR)", "(user_id // 2) || '-' || (i % 5)", "''", f"[{_FREE_SLOT}, {_FREE_SLOT}]", _NO_KEYS), _KEY_ROW.format(
    "x[1].i", "x[1].sec", "x[1].kind", "x[1].side", "x[1].who", "x[1].key", _KEYED, f"CASE WHEN x[1].side = 0 THEN [{_NEXT}, acc[-1].s[2]] ELSE [acc[-1].s[1], {_NEXT}] END",
    f"CASE WHEN {_KEYED} = 'booked' THEN list_append(acc[-1].used, {{'key': x[1].key, 'side': x[1].side}}) ELSE acc[-1].used END"), _KEY_ROW.format("CAST(-1 AS BIGINT)", "CAST(0 AS BIGINT)", "''", "CAST(0 AS BIGINT)", "''", "''", "''", f"[{_FREE_SLOT}, {_FREE_SLOT}]", _NO_KEYS)))
def keyed_bookings(t):
    """Two users' slots share their booking keys: a key used on the second slot is a conflict."""
    key = F.concat(F.floor(F.col("user_id") / 2).cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string"))
    return lg.book_with_keys(slot_work(t.events, key), "slot", "at", 50_000, "event_id").select("event_id", "result")


_LEVELS = ",\n".join(f"l{i} AS (SELECT p AS k, CASE WHEN min(d) < {i} THEN min(h) ELSE sha256(string_agg(k || ':' || h, chr(10) ORDER BY k)) END AS h FROM (SELECT *, CASE WHEN {i} > d THEN k ELSE substr(k, 1, {i}) END AS p FROM l{i + 1}, n) GROUP BY p)" for i in range(5, -1, -1))


@query(f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({CHAIN})),
c AS (SELECT user_id, n, event_id, sha256(sha256('genesis:' || user_id) || '|' || payload) AS hash FROM r WHERE n = 1
 UNION ALL SELECT r.user_id, r.n, r.event_id, sha256(c.hash || '|' || r.payload) FROM c JOIN r ON r.user_id = c.user_id AND r.n = c.n + 1),
h AS (SELECT user_id, arg_max(hash, n) AS hash FROM c WHERE event_id < (SELECT max(event_id) // 2 FROM events) GROUP BY user_id),
n AS (SELECT count(*) AS n, (SELECT min(d) FROM (SELECT unnest(generate_series(0, 12)) AS d) WHERE 8 * pow(16, d) >= (SELECT count(*) FROM h)) AS d FROM h),
l6 AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS k, sha256(user_id || ':' || hash) AS h FROM h),
{_LEVELS}
SELECT (SELECT n FROM n) AS subjects, h AS anchor FROM l0""")
def chain_anchor(t):
    """One hash over the heads of all users' chains as of the middle of the log."""
    middle = t.events.agg(F.floor(F.max("event_id") / 2).alias("m"))
    upto = chain(t).join(middle, F.col("event_id") < F.col("m")).select("user_id", "event_id", "hash")
    return lg.anchor(lg.heads(upto, "user_id", "event_id"), "user_id", width=8)


@query("""
WITH l AS (SELECT l_orderkey AS o, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price, l_returnflag AS k FROM lineitem), f AS (SELECT o, k, CASE k WHEN 'A' THEN 500 WHEN 'N' THEN 300 END AS fee FROM (SELECT DISTINCT o, k FROM l)),
i AS (SELECT o, CAST(sum(price) AS BIGINT) AS items, count(*) AS n FROM l GROUP BY o), g AS (SELECT o, CAST(coalesce(sum(fee), 0) AS BIGINT) AS fees, count(*) FILTER (fee IS NULL) AS missing FROM f GROUP BY o)
SELECT i.o AS o_orderkey, n, items, fees, items + fees AS total, missing FROM i JOIN g ON i.o = g.o""")
def booking_lines(t):
    """Orders as bookings: their lines, one fee for each kind among them, the total, and kinds without a fee."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), cents(F.col("l_extendedprice")).alias("price"), F.col("l_returnflag").alias("kind"))
    fee = F.when(F.col("kind") == "A", 500).when(F.col("kind") == "N", 300)
    kinds = lines.select("o_orderkey", "kind").distinct().groupBy("o_orderkey").agg(F.coalesce(F.sum(fee), F.lit(0)).alias("fees"), F.count_if(fee.isNull()).alias("missing"))
    items = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("items"))
    return items.join(kinds, "o_orderkey").select("o_orderkey", "n", "items", "fees", (F.col("items") + F.col("fees")).alias("total"), "missing")
