"""Appointment slots: generation from opening hours, effective state, availability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def generate_slots(places: DataFrame, days: DataFrame, hours: Column, step: int, keep: Column) -> DataFrame:
    """(places.*, day, start, end): slots of `step` minutes inside each interval of `hours`, where `keep` holds.

    `hours` and `keep` are expressions over places, days and (keep) the slot's start minute.
    """
    spans = places.crossJoin(days).withColumn("__x", F.explode(hours))
    last = F.col("__x.to") - step
    starts = spans.where(last >= F.col("__x.from")).withColumn("start", F.explode(F.sequence(F.col("__x.from"), last, F.lit(step))))
    return starts.where(keep).withColumn("end", F.col("start") + step).drop("__x")


def effective_status(status: Column, expires: Column, start: Column, now: Column) -> Column:
    """A hold that has run out is free again; a free slot that has begun is past."""
    state = F.when((status == "HELD") & (expires <= now), "FREE").otherwise(status)
    return F.when((state == "FREE") & (start <= now), "PAST").otherwise(state)


def has_room(blocked: Column, taken: Column, booked: Column, capacity: Column, start: Column, now: Column) -> Column:
    return ~F.coalesce(blocked, F.lit(False)) & (taken + booked < capacity) & (start > now)


def first_free(slots: DataFrame, keys: list[str], free: Column, order: list[str], n: int) -> DataFrame:
    """The first n free slots of each key as an array of structs, and how many there are.

    Tasks keep n slots of a key before the shuffle, however many it has.
    """
    chosen = slots.where(free)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = chosen.withColumn("__turn", turn).where(F.col("__turn") <= n)
    first = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("first")).select(*[F.col(k).alias(f"__{k}") for k in keys], "first")
    counts = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_free"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return counts.join(first, same).select(*keys, "n_free", "first")


def merged_sources(sources: dict[str, DataFrame | None], keys: list[str], start: str) -> DataFrame:
    """Slots of several sources end to end in order of start, each with its source and its turn within the keys; a source that failed is None."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items() if df is not None]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(start, "source")).cast("long")
    return reduce(DataFrame.unionByName, parts).withColumn("turn", turn)
