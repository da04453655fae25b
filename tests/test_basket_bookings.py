"""Bookings of laboratory slots: recomputed totals, reasons in order, places and keys, against one pass in plain Python."""

import random

import pytest

from loomery.operators import basket, ledger

OPS = "slot long, at long, tie long, kind string, key string, reason string, capacity long, starts long"


def one_pass(rows):
    taken, held, used, out = {}, {}, {}, {}
    for slot, at, tie, kind, key, reason, capacity, starts in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "cancel":
            if key is not None and held.get(key) == slot:
                del held[key]
                taken[slot] -= starts > at
                out[tie] = "cancelled"
            else:
                out[tie] = "nothing"
        elif key is None:
            out[tie] = "no_key"
        elif key in used:
            out[tie] = "repeated" if used[key] == slot else "conflict"
        elif reason is not None:
            out[tie] = reason
        elif capacity is None or taken.get(slot, 0) >= capacity:
            out[tie] = "slot_full"
        else:
            taken[slot] = taken.get(slot, 0) + 1
            held[key] = used[key] = slot
            out[tie] = "booked"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_places_and_keys(spark, seed):
    rng = random.Random(seed)
    rows, now = [], 0
    for tie in range(220):
        now += rng.choice([0, 0, 1, 7])
        slot = rng.randrange(6)
        key = rng.choice([None, *(f"k{i}" for i in range(25))])
        rows.append((slot, now, tie, rng.choice(["book", "book", "cancel"]), key, rng.choice([None, None, None, "price_changed"]), None if slot == 5 else 1 + slot % 3, rng.choice([now, 900])))
    got = {r.tie: r.result for r in ledger.book_places(spark.createDataFrame(rows, OPS), "slot", "at", "tie").collect()}
    want = one_pass(rows)
    assert got == want and {"booked", "slot_full", "conflict", "repeated", "cancelled", "price_changed"} <= set(want.values())


def test_no_operations(spark):
    assert ledger.book_places(spark.createDataFrame([], OPS), "slot", "at", "tie").collect() == []


def test_reasons_in_order(spark):
    branches = spark.createDataFrame([(1, True), (2, False), (3, True)], "branch int, active boolean")
    slots = spark.createDataFrame([(10, 1, 100, 2), (30, 3, 100, 2)], "slot int, branch int, starts int, capacity int")
    offers = spark.createDataFrame([(1, "a", 70), (1, "b", 30), (1, "c", 5), (3, "a", 60)], "branch int, code string, price int")
    fees = spark.createDataFrame([(1, "blood", 9)], "branch int, kind string, fee int")
    asked = [
        (1, 1, 10, 0, 109, ["a", "b", "a"], None, 109),  # a test named twice counts once, one fee for both
        (2, 1, 10, 0, 108, ["a", "b"], "price_changed", 109),
        (3, 1, 10, 0, None, ["a", "b"], None, 109),  # no expectation
        (4, 1, 10, 0, None, [], "bad_request", 0),
        (5, 2, 10, 0, None, ["a"], "branch_not_found", 0),
        (6, 9, 10, 0, None, ["a"], "branch_not_found", 0),
        (7, 1, 30, 0, None, ["a"], "slot_not_found", 79),
        (8, 1, 99, 0, None, ["zz"], "slot_not_found", 0),
        (9, 1, 10, 100, None, ["zz"], "slot_past", 0),  # the slot is asked for before the tests
        (10, 1, 10, 0, 1, ["a", "zz"], "test_unavailable", 79),  # before the price
        (11, 1, 10, 0, None, ["c"], "test_unavailable", 5),  # its fee is not known
        (12, 1, 10, 0, None, ["a", "b", "d"], "bad_request", 109),  # more than two here
    ]
    requests = spark.createDataFrame([(i, b, s, at, e) for i, b, s, at, e, *_ in asked], "id int, branch int, slot int, at int, expected long")
    kind = {"c": "urine"}
    wanted = spark.createDataFrame([(i, c, kind.get(c, "blood")) for i, *_, codes, _, _ in asked for c in codes], "id int, code string, kind string")
    got = {r.id: (r.reason, r.total) for r in basket.booking_reasons(requests, wanted, branches, slots, offers, fees, most=2).collect()}
    assert got == {i: (reason, total) for i, *_, reason, total in asked}
