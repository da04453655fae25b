"""Basket quotes: who offers everything that is asked for, for how much, and what is missing elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quote(offers: DataFrame, basket: DataFrame, fees: DataFrame, branch: str, item: list[str], price: str, kind: str, fee: str, extra: list[Column] | None = None) -> DataFrame:
    """Per branch: items found and missing, their sum, one fee per distinct kind among them, the total.

    `basket` has a row per wanted item with its kind; `fees` a row per branch and kind. A kind whose fee a branch
    does not name is missing there like an item, as its total is not known. Branches that
    offer nothing of the basket are left out. A basket is what one request names, so it is broadcast
    when its measured size allows, by Spark itself.
    """
    wanted = basket.agg(F.count(F.lit(1)).alias("n_wanted"))
    found = offers.join(basket, item)
    items = found.groupBy(branch).agg(F.count(F.lit(1)).alias("n_found"), F.sum(price).cast("long").alias("items"), *(extra or []))
    kinds = found.select(branch, kind).distinct().join(fees.select(branch, kind, fee), [branch, kind], "left")
    kinds = kinds.groupBy(branch).agg(F.coalesce(F.sum(fee), F.lit(0)).cast("long").alias("fees"), F.count_if(F.col(fee).isNull()).alias("__no_fee"))
    out = items.join(kinds, branch).crossJoin(wanted)
    missing = F.col("n_wanted") - F.col("n_found") + F.col("__no_fee")
    return out.withColumns({"missing": missing, "total": F.col("items") + F.col("fees")}).drop("n_wanted", "__no_fee")


#: Stages of a quote in order; a branch is counted in those that it passes.
QUOTE_STAGES = ("branches", "complete", "price", "turnaround", "travel", "slots")
NOON = 12 * 60


def quote_options(quotes: DataFrame, slots: DataFrame, branch: str, most_total: int | None = None, most_hours: int | None = None, most_minutes: int | None = None, fasting: bool = False, from_minute: int | None = None, to_minute: int | None = None) -> DataFrame:
    """quotes with their free slots and `passed`, the number of QUOTE_STAGES that each branch passes.

    quotes: branch, missing, total, turnaround (hours), minutes (travel, null if unknown). slots: branch, day, minute,
    a row for each free one. Fasting tests are taken before noon unless hours are asked for; unknown travel
    does not pass a limit. Adds slots, first_slot (minutes from day 0) and ready (first_slot plus turnaround).
    """
    until = NOON if fasting and from_minute is None and to_minute is None else to_minute
    open_ = slots
    if from_minute is not None:
        open_ = open_.where(F.col("minute") >= from_minute)
    if until is not None:
        open_ = open_.where(F.col("minute") < until)
    first = F.min(F.col("day") * 1440 + F.col("minute")).cast("long")
    held = open_.groupBy(branch).agg(F.count(F.lit(1)).alias("slots"), first.alias("first_slot"))
    out = quotes.join(held, branch, "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    limit = lambda c, most: F.lit(True) if most is None else F.coalesce(F.col(c) <= most, F.lit(False))
    stages = [F.col("missing") == 0, limit("total", most_total), limit("turnaround", most_hours), limit("minutes", most_minutes), F.col("slots") > 0]
    passed, so_far = F.lit(1), F.lit(True)
    for stage in stages:
        so_far = so_far & stage
        passed = passed + so_far.cast("int")
    return out.withColumns({"passed": passed, "ready": F.col("first_slot") + F.col("turnaround") * 60})


def quote_funnel(options: DataFrame) -> DataFrame:
    """(stage, branches): how many branches pass each stage, in one pass."""
    counts = options.agg(*[F.count_if(F.col("passed") > i).alias(n) for i, n in enumerate(QUOTE_STAGES)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("branches")) for n in QUOTE_STAGES])).alias("x")).select("x.*")


def badges(quotes: DataFrame, total: str, slow: str, unique: str) -> DataFrame:
    """Marks the cheapest and the fastest of the complete quotes, one each."""
    first = lambda c: F.min_by(unique, F.struct(F.col(c).isNull(), F.col(c), F.col(unique)))
    best = quotes.where("missing = 0").agg(first(total).alias("__cheapest"), first(slow).alias("__fastest"))
    marked = quotes.crossJoin(best)
    return marked.withColumns({k: (F.col("missing") == 0) & F.col(unique).eqNullSafe(F.col(f"__{k}")) for k in ("cheapest", "fastest")}).drop("__cheapest", "__fastest")


def contained(sets: DataFrame, name: str, member: str) -> DataFrame:
    """(name, inside, n): sets all of whose members are in another set.

    Whatever holds a set holds its rarest member, so pairs come from that one and are then counted out.
    """
    rows = sets.select(name, member).distinct()
    sizes = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    held = rows.groupBy(member).agg(F.count(F.lit(1)).alias("__c"))
    rarest = rows.join(held, member).groupBy(name).agg(F.min_by(member, F.struct("__c", member)).alias(member))
    other = rows.select(F.col(name).alias("inside"), member)
    pairs = rarest.join(other, member).where(F.col(name) != F.col("inside")).select(name, "inside")
    shared = pairs.join(rows, name).join(other, ["inside", member]).groupBy(name, "inside").agg(F.count(F.lit(1)).alias("n"))
    return shared.join(sizes, [name, "n"]).select(name, "inside", "n")


def offer_statistics(offers: DataFrame, item: list[str], branch: str, price: str) -> DataFrame:
    """Per item: lowest and highest price and how many branches offer it."""
    return offers.groupBy(*item).agg(F.min(price).alias("lowest"), F.max(price).alias("highest"), F.count_distinct(branch).alias("branches"))


def price_lines(wanted: DataFrame, offers: DataFrame, fees: DataFrame, branch: str, code: str, kind: str, price: str, fee: str) -> DataFrame:
    """(branch, line, what, name, price): tests offered, then one fee for each of their kinds; what is missing has no line and no price.

    wanted: branch, code and the code's kind. what: test, fee, missing_test or missing_fee.
    """
    found = wanted.distinct().join(offers.select(branch, code, F.col(price).alias("__p")), [branch, code], "left")
    tests = found.select(branch, F.when(F.col("__p").isNull(), "missing_test").otherwise("test").alias("what"), F.col(code).cast("string").alias("name"), F.col("__p").alias("price"))
    kinds = found.where(F.col("__p").isNotNull()).select(branch, kind).distinct().join(fees.select(branch, kind, F.col(fee).alias("__f")), [branch, kind], "left")
    fee_rows = kinds.select(branch, F.when(F.col("__f").isNull(), "missing_fee").otherwise("fee").alias("what"), F.col(kind).cast("string").alias("name"), F.col("__f").alias("price"))
    rows = tests.unionByName(fee_rows)
    turn = F.row_number().over(Window.partitionBy(branch, F.col("price").isNull()).orderBy(F.desc("what"), "name"))
    return rows.withColumn("line", F.when(F.col("price").isNotNull(), turn)).select(branch, "line", "what", "name", "price")


#: Most different tests of one booking: a fixed value.
MOST_TESTS = 25


def booking_reasons(requests: DataFrame, wanted: DataFrame, branches: DataFrame, slots: DataFrame, offers: DataFrame, fees: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """requests with total, capacity, starts and reason: what a booking would cost now, and why it is refused.

    requests: id, branch, slot, at, expected (the total its sender saw; null: any). wanted: id, code, kind. branches: branch,
    active. slots: slot, branch, starts, capacity. offers: branch, code, price. fees: branch, kind, fee. The total is the sum of prices
    and of one fee for each kind among the offered tests, made anew from the tables, not taken from the request. In
    order: bad_request (no tests, or more than `most`), branch_not_found, slot_not_found (none such, or of another branch), slot_past,
    test_unavailable (a test or a fee is not offered), price_changed (the total is not the expected one). No code twice.
    """
    asked = wanted.select("id", "code", "kind").distinct().join(requests.select("id", "branch"), "id")
    found = asked.join(offers.select("branch", "code", "price"), ["branch", "code"], "left")
    lines = found.groupBy("id").agg(F.count_distinct("code").alias("__n"), F.count_if(F.col("price").isNull()).alias("__lacks"), F.coalesce(F.sum("price"), F.lit(0)).cast("long").alias("__items"))
    kinds = found.where("price IS NOT NULL").select("id", "branch", "kind").distinct().join(fees.select("branch", "kind", "fee"), ["branch", "kind"], "left")
    dues = kinds.groupBy("id").agg(F.count_if(F.col("fee").isNull()).alias("__owes"), F.coalesce(F.sum("fee"), F.lit(0)).cast("long").alias("__fees"))
    places = slots.select("slot", F.col("branch").alias("__of"), "starts", "capacity")
    out = requests.join(branches.select("branch", "active"), "branch", "left").join(places, "slot", "left").join(lines, "id", "left").join(dues, "id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumn("total", none("__items") + none("__fees"))
    reason = (
        F.when((none("__n") == 0) | (none("__n") > most), "bad_request")
        .when(~F.coalesce("active", F.lit(False)), "branch_not_found")
        .when(~F.coalesce(F.col("__of") == F.col("branch"), F.lit(False)), "slot_not_found")
        .when(F.col("starts") <= F.col("at"), "slot_past")
        .when(none("__lacks") + none("__owes") > 0, "test_unavailable")
        .when(F.col("expected") != F.col("total"), "price_changed")
    )
    return out.withColumn("reason", reason).select(*requests.columns, "total", "capacity", "starts", "reason")


def admit(requests: DataFrame, slot: str, order: list[str], refused: Column, capacity: str) -> DataFrame:
    """result of each booking in order: its own reason to refuse, else slot_full once `capacity` were booked, else booked.

    What is refused takes no place, so a running count of the others decides.
    """
    turn = F.sum(F.col("__reason").isNull().cast("int")).over(Window.partitionBy(slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = requests.withColumn("__reason", refused).withColumn("__turn", turn)
    return marked.withColumn("result", F.coalesce("__reason", F.when(F.col("__turn") > F.col(capacity), "slot_full"), F.lit("booked"))).drop("__reason", "__turn")


#: Sort modes of quotes: fixed orders; unknown minutes count as 999.
QUOTE_SORTS = {"total": ["total", "__m"], "distance": ["__m", "total"], "turnaround": ["ready", "turnaround", "total"], "soonest": ["first_slot", "total"]}


def quote_ranks(quotes: DataFrame, unique: str, top: int) -> DataFrame:
    """(mode, rank, unique) of the first `top` quotes in each sort mode; every task keeps no more than that."""
    rows = quotes.withColumn("__m", F.coalesce("minutes", F.lit(999)))
    out = None
    for mode, keys in QUOTE_SORTS.items():
        order = [*[F.asc_nulls_last(k) for k in keys], F.asc(unique)]
        one = rows.orderBy(*order).limit(top).select(F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), unique)
        out = one if out is None else out.unionByName(one)
    return out
