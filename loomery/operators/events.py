"""Product-event analytics: session funnels, attribution of actions to searches, daily summaries and their merge.

An event has a day, a session id, an order inside the log, a kind and facets. Kinds are told by
predicates, so the same operators serve any event table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent


@dataclass(frozen=True)
class Kinds:
    """Column names of event logs and the predicates that tell events apart."""

    search: Column
    opened: Column
    action: Column
    satisfied: Column
    day: str = "day"
    session: str = "sid"
    order: str = "seq"

    @property
    def success(self) -> Column:
        return self.action | self.satisfied


def with_search_number(events: DataFrame, k: Kinds) -> DataFrame:
    """search_no: how many searches the session has made up to the event; 0 before the first."""
    so_far = Window.partitionBy(k.day, k.session).orderBy(k.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("search_no", F.sum(k.search.cast("int")).over(so_far).cast("long"))


def attribute(events: DataFrame, k: Kinds, keep: list[Column] | None = None) -> DataFrame:
    """A row per search: whether anything after it, and before the next one, made it successful.

    `keep` are aggregates over the rows of the search, for example facets of the search event itself.
    """
    numbered = with_search_number(events, k).where("search_no > 0")
    extra = keep or []
    return numbered.groupBy(k.day, k.session, "search_no").agg(F.bool_or(k.success).alias("successful"), F.bool_or(k.opened).alias("opened"), F.count_if(k.action).alias("actions"), *extra)


def session_flags(events: DataFrame, k: Kinds) -> DataFrame:
    """A row per session of a day: did it search, open, act, say it was satisfied."""
    flags = [F.bool_or(c).alias(n) for n, c in (("searched", k.search), ("opened", k.opened), ("acted", k.action), ("satisfied", k.satisfied))]
    return events.groupBy(k.day, k.session).agg(*flags, F.count(F.lit(1)).alias("n_events"))


def funnel(events: DataFrame, k: Kinds) -> DataFrame:
    """A row per day: sessions and how many reached each step, searches and successful ones, rates."""
    steps = session_flags(events, k).groupBy(k.day).agg(F.count(F.lit(1)).alias("sessions"), *[F.count_if(n).alias(n) for n in ("searched", "opened", "acted", "satisfied")])
    searches = attribute(events, k).groupBy(k.day).agg(F.count(F.lit(1)).alias("searches"), F.count_if("successful").alias("successful"))
    joined = steps.join(searches, k.day, "left").fillna(0, ["searches", "successful"])
    return joined.withColumns({"acted_rate": percent(F.col("acted"), F.col("searched")), "success_rate": percent(F.col("successful"), F.col("searches"))})


def merge_days(daily: DataFrame, measures: list[str]) -> DataFrame:
    """Sum of daily partial summaries; a session across midnight counts on both of its days."""
    return daily.agg(F.count(F.lit(1)).alias("days"), *[F.sum(m).cast("long").alias(m) for m in measures])


def ranked(counts: DataFrame, by: str, keys: list[str], limit: int | None = None, partition: list[str] | None = None) -> DataFrame:
    """Rows numbered by count, largest first, ties by key; the first `limit` of each partition."""
    order = Window.partitionBy(*(partition or [])).orderBy(F.desc(by), *keys)
    out = counts.withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= limit) if limit else out


def sanitise(raw: DataFrame, payload: str, allowed: dict[str, str], required: list[str], checks: dict[str, Column]) -> DataFrame:
    """Validate or drop JSON events: unknown keys, missing keys, wrong types or a failed check reject the event.

    Adds `event` (a struct) to the rows that pass.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in allowed.items())
    keys = F.map_keys(F.from_json(payload, "map<string,string>"))
    parsed = raw.withColumns({"__keys": keys, "event": F.from_json(payload, schema, {"mode": "PERMISSIVE"})})
    fine = F.col("__keys").isNotNull() & (F.size(F.array_except("__keys", F.array(*[F.lit(k) for k in allowed]))) == 0)
    for name in required:
        fine = fine & F.col(f"event.{name}").isNotNull()
    for name in allowed:  # a key with a value of another type parses to null
        fine = fine & (~F.array_contains("__keys", name) | F.col(f"event.{name}").isNotNull())
    for check in checks.values():
        fine = fine & F.coalesce(check, F.lit(True))
    return parsed.where(fine).drop("__keys")


def daily_cap(events: DataFrame, day: str, order: list[str], cap: int) -> DataFrame:
    """accepted: the first `cap` events of each day, in log order; `order` must tell a day's events apart."""
    return within_cap(events, day, order, F.lit(cap))


def within_cap(events: DataFrame, day: str, order: list[str], cap: Column, parts: int = 64) -> DataFrame:
    """accepted: the first `cap` (a number that may depend on the day) of each day.

    The last place that fits is found from the first ones of each of `parts` parts of a day, so no task
    sorts a whole day; rows then compare with it.
    """
    place = F.struct(*order)
    part = Window.partitionBy(day, "__part").orderBy("__place")
    keyed = events.select(day, place.alias("__place"), cap.alias("__cap"), F.pmod(F.xxhash64(*order), F.lit(parts)).alias("__part"))
    first = keyed.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= F.col("__cap"))
    last = first.withColumn("__n", F.row_number().over(Window.partitionBy(day).orderBy("__place"))).where(F.col("__n") == F.col("__cap"))
    marked = events.join(last.select(day, F.col("__place").alias("__last")), day, "left")
    fits = F.when(cap <= 0, False).when(F.col("__last").isNull(), True).otherwise(place <= F.col("__last"))
    return marked.withColumn("accepted", fits).drop("__last")
