"""Ledgers and controls: hash chains, state machines, folds over operation logs, limiters, lockouts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import kept


def genesis(owner: Column) -> Column:
    return F.sha2(F.concat(F.lit("genesis:"), owner.cast("string")), 256)


def link(before: Column, payload: Column) -> Column:
    return F.sha2(F.concat(before, F.lit("|"), payload), 256)


def build_chain(records: DataFrame, owner: str, order: str, payload: str) -> DataFrame:
    """Each record with its place, prev_hash and hash, in order of its owner's records.

    A chain can only be made one record after another; a task reads its owners' records in order, as a
    stream that keeps no more than the last hash, so a long chain takes time but no memory.
    """
    rows = records.select(owner, F.lit(0).alias("place"), order, F.col(payload).cast("string").alias(payload), F.col(owner).cast("string").alias("__owner"))
    schema = T.StructType([records.schema[owner], T.StructField("place", T.IntegerType()), records.schema[order], T.StructField(payload, T.StringType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, place, last = None, 0, ""
        for batch in batches:
            places, before, after = [], [], []
            for name, text in zip(batch["__owner"], batch[payload], strict=True):
                if name != who:
                    who, place, last = name, 0, hashlib.sha256(f"genesis:{name}".encode()).hexdigest()
                places.append(place)
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                after.append(last)
                place += 1
            yield batch.drop(columns="__owner").assign(place=places, prev_hash=before, hash=after)

    return rows.where(F.col("__owner").isNotNull()).repartition(owner).sortWithinPartitions(owner, order).mapInPandas(run, schema)


def verify_chain(chain: DataFrame, owner: str, order: str, payload: str) -> DataFrame:
    """(owner, n, broken): records whose hash or whose link to the one before does not hold."""
    before = F.lag("hash").over(Window.partitionBy(owner).orderBy(order))
    bad = (F.col("prev_hash") != F.coalesce(before, genesis(F.col(owner)))) | (F.col("hash") != link(F.col("prev_hash"), F.col(payload)))
    return chain.withColumn("__bad", bad).groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.count_if("__bad").alias("broken"))


def current(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def transitions(log: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """allowed: may the state follow the one before (null for a first state); `allowed` has (before, after)."""
    seen = log.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    pairs = allowed.select(F.col("before"), F.col("after").alias(state), F.lit(True).alias("__ok"))
    joined = seen.join(pairs, ["before", state], "left")
    return joined.withColumn("allowed", F.when(F.col("before").isNull() | (F.col("before") == F.col(state)), True).otherwise(F.coalesce("__ok", F.lit(False)))).drop("__ok")


def newest_within(rows: DataFrame, keys: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """The newest rows of a key whose sizes sum to the budget; the newest one always stays."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    summed = rows.withColumns({"__sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__r": F.row_number().over(w)})
    return summed.where((F.col("__r") == 1) | (F.col("__sum") <= budget)).drop("__sum", "__r")


def capped(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """kept: the newest `most` rows of each key, as when the oldest sessions end."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= most)


def prune(partitions: DataFrame, day: str, size: str, oldest: Column, most_bytes: int) -> DataFrame:
    """kept: partitions not older than `oldest`, newest first while their sizes fit; the newest always."""
    w = Window.orderBy(F.desc(day))
    fits = F.sum(F.when(F.col(day) >= oldest, F.col(size)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= most_bytes
    return partitions.withColumn("kept", ((F.col(day) >= oldest) & fits) | (F.row_number().over(w) == 1))


def _fold(rows: DataFrame, keys: list[str], order: str, step, start, schema: T.StructType, tie: str | None = None) -> DataFrame:
    """Sequential decisions over the rows of each key: step(state, row) -> (state, columns). `tie` orders rows of one time.

    A task reads its keys' rows in order, as a stream that keeps one key's state and no history.
    """
    by = [order, tie] if tie else [order]
    added = schema.fieldNames()[len(rows.columns) :]

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for block in blocks:
            made = []
            names = zip(*(block[k].astype(object).where(block[k].notna(), None) for k in keys), strict=True)
            for name, row in zip(names, block.itertuples(index=False), strict=True):
                if name != who:
                    who, state = name, start()
                state, columns = step(state, row)
                made.append(columns)
            yield block.assign(**{n: [m[i] for m in made] for i, n in enumerate(added)})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *by).mapInPandas(run, schema)


def _with(rows: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def sliding_limit(rows: DataFrame, keys: list[str], at: str, span: int, most: int, tie: str | None = None) -> DataFrame:
    """accepted: fewer than `most` requests accepted in the last `span`; a rejected one takes no room."""

    def step(held: list, row):
        held = [x for x in held if x > getattr(row, at) - span]
        fine = len(held) < most
        return (held + [getattr(row, at)] if fine else held), (fine,)

    return _fold(rows, keys, at, step, list, _with(rows, accepted=T.BooleanType()), tie)


def token_bucket(rows: DataFrame, keys: list[str], at: str, cost: str, capacity: float, per_unit: float, tie: str | None = None) -> DataFrame:
    """accepted while the level is above 0, and the level after the cost is charged; it refills to capacity."""

    def step(state, row):
        level, last = state if state else (capacity, getattr(row, at))
        level = min(capacity, level + (getattr(row, at) - last) * per_unit)
        fine = level > 0
        level = level - getattr(row, cost) if fine else level
        return (level, getattr(row, at)), (fine, float(level))

    return _fold(rows, keys, at, step, lambda: None, _with(rows, accepted=T.BooleanType(), level=T.DoubleType()), tie)


def lockout(rows: DataFrame, keys: list[str], at: str, failed: str, window: int, threshold: int, base: int, most: int, memory: int, tie: str | None = None) -> DataFrame:
    """locked: attempts while a lock holds. Failures inside `window` that reach the threshold lock for
    base * 2**n, at most `most`, n locks having gone before within `memory`; a success clears the failures.
    """

    def step(state, row):
        fails, until, locks, last = state
        now = getattr(row, at)
        if now < until:
            return state, (True, int(until))
        if last is not None and now - last > memory:
            locks = 0
        fails = [x for x in fails if x > now - window]
        if not getattr(row, failed):
            return ([], until, locks, last), (False, 0)
        fails.append(now)
        if len(fails) >= threshold:
            return ([], now + min(most, base * 2**locks), locks + 1, now), (False, int(now + min(most, base * 2**locks)))
        return (fails, until, locks, last), (False, 0)

    return _fold(rows, keys, at, step, lambda: ([], -1, 0, None), _with(rows, locked=T.BooleanType(), until=T.LongType()), tie)


def apply_slot_operations(ops: DataFrame, slot: str, at: str, ttl: int, tie: str | None = None) -> DataFrame:
    """result of hold, release, book and cancel on each slot, folded in order of time.

    ops: slot, time, kind, who (holder token), key (idempotency), starts (of the slot). A hold takes a
    free slot or one whose hold ran out, before it starts. A booking takes a free slot or its own hold;
    the same key again gets the same answer. Cancelling frees a slot that has not started; again, nothing.
    """

    def step(state, row):
        status, who, until, key = state
        now = getattr(row, at)
        if status == "HELD" and until <= now:
            status, who = "FREE", None
        future = row.starts > now
        if row.kind == "hold":
            if status == "FREE" and future:
                return ("HELD", row.who, now + ttl, key), ("held",)
            return (status, who, until, key), ("taken",)
        if row.kind == "release":
            if status == "HELD" and who == row.who:
                return ("FREE", None, 0, key), ("released",)
            return (status, who, until, key), ("not_held",)
        if row.kind == "book":
            if status == "BOOKED":
                return (status, who, until, key), ("booked" if key == row.key else "taken",)
            if future and (status == "FREE" or who == row.who):
                return ("BOOKED", row.who, 0, row.key), ("booked",)
            return (status, who, until, key), ("taken",)
        if status == "BOOKED" and key == row.key:
            return ("FREE" if future else "CANCELLED", None, 0, None), ("cancelled",)
        return (status, who, until, key), ("nothing",)

    return _fold(ops, [slot], at, step, lambda: ("FREE", None, 0, None), _with(ops, result=T.StringType()), tie)


def _elsewhere(row, slot: str, me: tuple) -> bool:
    """Has this row's key booked another slot before? Its first booking comes beside the row; a null may reach Python as nan."""
    return row.first_slot is not None and row.first_slot == row.first_slot and row.first_slot != getattr(row, slot) and (row.first_at, row.first_tie) < me


def _across_keys(ops: DataFrame, slot: str, at: str, tie: str, step, start) -> DataFrame:
    """result of every operation where step(state of its slot, row) also sees first_slot, first_at and first_tie: the first
    row with the result `booked` of the row's key, if that key is used on several slots.

    Rounds to a fixed point, as book_with_keys tells.
    """
    book = ops.where(F.col("kind") == "book").where("key IS NOT NULL")
    several = kept(book.groupBy("key").agg(F.min(slot).alias("a"), F.max(slot).alias("b")).where("a <> b").select("key"))
    touched = kept(book.join(several, "key", "left_semi").select(slot).distinct())
    none = ops.schema[slot].dataType, ops.schema[at].dataType, ops.schema[tie].dataType
    names = ("first_slot", "first_at", "first_tie")

    def folded(part: DataFrame, first: DataFrame | None) -> DataFrame:
        if first is None:
            given = part.withColumns({n: F.lit(None).cast(k) for n, k in zip(names, none, strict=True)})
        else:
            given = part.join(first, "key", "left").select(*part.columns, *names)
        return _fold(given, [slot], at, step, start, _with(given, result=T.StringType()), tie).drop(*names)

    def claims(results: DataFrame) -> DataFrame:
        won = results.where((F.col("kind") == "book") & (F.col("result") == "booked")).join(several, "key", "left_semi")
        first = won.groupBy("key").agg(F.min(F.struct(at, tie, slot)).alias("f"))
        return kept(first.select("key", *[F.col(f"f.{c}").alias(n) for n, c in zip(names, (slot, at, tie), strict=True)]))

    settled = folded(ops.join(touched, slot, "left_anti"), None)
    apart = kept(ops.join(touched, slot, "left_semi").select(*ops.columns))
    results, first = kept(folded(apart, None)), None
    while True:
        found = claims(results)
        if first is not None:
            same = F.col("o.key") == F.col("n.key")
            moved = first.alias("o").join(found.alias("n"), same, "full").where(~F.struct("o.*").eqNullSafe(F.struct("n.*"))).select(F.coalesce("o.key", "n.key").alias("key"))
        else:
            moved = found.select("key")
        moved = kept(moved)
        if moved.isEmpty():
            return settled.unionByName(results)
        again = kept(apart.where(F.col("kind") == "book").join(moved, "key", "left_semi").select(slot).distinct())
        fresh = folded(apart.join(again, slot, "left_semi").select(*ops.columns), found)
        results, first = kept(results.join(again, slot, "left_anti").select(*results.columns).unionByName(fresh)), found


def book_with_keys(ops: DataFrame, slot: str, at: str, ttl: int, tie: str) -> DataFrame:
    """result of the operations of apply_slot_operations where a booking's key counts on all slots.

    A key that has booked a slot answers later bookings of that slot with repeated, whatever has become of it, and
    those of another slot with conflict. A decision thus depends on the slot's and on the key's past at once. Slots are folded apart, given the first booking of
    every key that is used on several slots; what they book is then taken for those first bookings, and slots
    whose keys' first bookings have changed are folded again until none has. Decisions only look back in
    time, so what stands still is what one pass over all operations would say. Bookings without a key are refused.
    """
    def step(state, row):
        status, who, until, key, used = state
        now, me = getattr(row, at), (getattr(row, at), getattr(row, tie))
        if status == "HELD" and until <= now:
            status, who = "FREE", None
        future = row.starts > now
        same = (status, who, until, key, used)
        if row.kind == "hold":
            return (("HELD", row.who, now + ttl, key, used), ("held",)) if status == "FREE" and future else (same, ("taken",))
        if row.kind == "release":
            return (("FREE", None, 0, key, used), ("released",)) if status == "HELD" and who == row.who else (same, ("not_held",))
        if row.kind == "book":
            if row.key is None:
                return same, ("no_key",)
            if row.key in used:
                return same, ("repeated",)
            if _elsewhere(row, slot, me):
                return same, ("conflict",)
            if status != "BOOKED" and future and (status == "FREE" or who == row.who):
                return ("BOOKED", row.who, 0, row.key, used | {row.key}), ("booked",)
            return same, ("taken",)
        if status == "BOOKED" and key == row.key:
            return ("FREE" if future else "CANCELLED", None, 0, None, used), ("cancelled",)
        return same, ("nothing",)

    return _across_keys(ops, slot, at, tie, step, lambda: ("FREE", None, 0, None, frozenset()))


def book_places(ops: DataFrame, slot: str, at: str, tie: str) -> DataFrame:
    """result of bookings of slots with several places, and of their cancellations, in order of time.

    ops: slot, time, kind (book or cancel), key (idempotency), reason (why the booking is refused for what it asks, null
    if it is not), capacity and starts (of the slot). A booking without a key is refused (no_key); a key that has booked
    answers later bookings of that slot with repeated and of another with conflict, before anything else is asked; then
    its own reason counts, then whether a place is left (slot_full). Refused bookings take no place and no key. Cancelling a key's booking
    gives its place back if the slot has not started; the key stays used. A null capacity is none.
    """

    def step(state, row):
        taken, held, used = state
        now, me = getattr(row, at), (getattr(row, at), getattr(row, tie))
        if row.kind == "cancel":
            if row.key is None or row.key not in held:
                return state, ("nothing",)
            return (taken - (row.starts > now), held - {row.key}, used), ("cancelled",)
        if row.key is None:
            return state, ("no_key",)
        if row.key in used:
            return state, ("repeated",)
        if _elsewhere(row, slot, me):
            return state, ("conflict",)
        if row.reason is not None:
            return state, (row.reason,)
        if not taken < row.capacity:
            return state, ("slot_full",)
        return (taken + 1, held | {row.key}, used | {row.key}), ("booked",)

    return _across_keys(kept(ops), slot, at, tie, step, lambda: (0, frozenset(), frozenset()))


def heads(chain: DataFrame, owner: str, order: str, until: Column | None = None) -> DataFrame:
    """(owner, hash): the last hash of every owner's chain among the records that `until` admits."""
    rows = chain if until is None else chain.where(until)
    return rows.groupBy(owner).agg(F.max_by("hash", order).alias("hash"))


def anchor(last: DataFrame, owner: str, width: int = 256) -> DataFrame:
    """(subjects, anchor): one hash over the heads of all chains, as a tree.

    A head's leaf is the sha-256 of 'owner:hash', and its place the sha-256 of the owner. Leaves that begin alike, by
    as many hexadecimal digits as give about `width` leaves to a group, are hashed together in order, then those
    groups by one digit less, up to the root: no task has more than a group. The number of digits follows from the number of
    heads alone, so the same heads give the same anchor on any machines; without heads it is the hash of nothing.
    """
    leaf = kept(last.select(F.sha2(F.col(owner).cast("string"), 256).alias("k"), F.sha2(F.concat(F.col(owner).cast("string"), F.lit(":"), F.col("hash")), 256).alias("h")))
    n = leaf.count()
    digits = 0
    while width * 16**digits < n:
        digits += 1
    level = leaf
    for d in range(digits, -1, -1):
        pairs = F.array_sort(F.collect_list(F.struct("k", "h")))
        text = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(":"), p["h"])), "\n")
        level = level.withColumn("p", F.substring("k", 1, d)).groupBy("p").agg(F.sha2(text, 256).alias("h")).withColumnRenamed("p", "k")
    empty = F.sha2(F.lit(""), 256)
    return level.agg(F.coalesce(F.max("h"), empty).alias("anchor")).select(F.lit(n).cast("long").alias("subjects"), "anchor")


def forget(rows: DataFrame, owner: str, day: Column, cutoff: Column) -> DataFrame:
    """The owner is forgotten on rows older than the cutoff."""
    return rows.withColumn(owner, F.when(day >= cutoff, F.col(owner)))
