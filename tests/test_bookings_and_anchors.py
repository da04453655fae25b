"""Bookings whose keys count on all slots, anchors over chains, slots as a stream, cascades with a budget: against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import ledger, linking
from loomery.streaming import slots

OPS = "slot long, at long, tie long, kind string, who string, key string, starts long"


def operations(seed, n=160, slots_=5, keys=6):
    rng = random.Random(seed)
    rows, now = [], 0
    for tie in range(n):
        now += rng.choice([0, 1, 5, 30])
        kind = rng.choice(["hold", "book", "book", "release", "cancel"])
        rows.append((rng.randrange(slots_), now, tie, kind, rng.choice("ab"), rng.choice([None, *(f"k{i}" for i in range(keys))]) if kind in ("book", "cancel") else None, 700 if rng.random() < 0.9 else now))
    return rows


def one_pass(rows, ttl):
    """All operations in one sequence over all slots and keys."""
    state, used, out = {}, {}, {}
    for slot, at, tie, kind, who, key, starts in sorted(rows, key=lambda r: (r[1], r[2])):
        status, holder, until, own = state.get(slot, ("FREE", None, 0, None))
        if status == "HELD" and until <= at:
            status, holder = "FREE", None
        result = "nothing"
        if kind == "hold":
            result = "held" if status == "FREE" and starts > at else "taken"
            if result == "held":
                status, holder, until = "HELD", who, at + ttl
        elif kind == "release":
            result = "released" if status == "HELD" and holder == who else "not_held"
            if result == "released":
                status, holder, until = "FREE", None, 0
        elif kind == "book":
            if key is None:
                result = "no_key"
            elif key in used:
                result = "repeated" if used[key] == slot else "conflict"
            elif status != "BOOKED" and starts > at and (status == "FREE" or holder == who):
                result, status, holder, until, own, used[key] = "booked", "BOOKED", who, 0, key, slot
            else:
                result = "taken"
        elif status == "BOOKED" and own == key:
            result, status, holder, until, own = "cancelled", "FREE" if starts > at else "CANCELLED", None, 0, None
        state[slot], out[tie] = (status, holder, until, own), result
    return out


@pytest.mark.parametrize("seed", range(3))
def test_keys_across_slots(spark, seed):
    rows = operations(seed)
    want = one_pass(rows, 40)
    got = {r.tie: r.result for r in ledger.book_with_keys(spark.createDataFrame(rows, OPS).repartition(4), "slot", "at", 40, "tie").collect()}
    assert got == want and {"conflict", "repeated", "booked"} <= set(want.values())


def test_keys_of_chains_of_slots(spark):
    """Each slot's only booking hangs on whether the one before took its key: the decision runs through all slots."""
    rows = [(i, 10 * i + j, 2 * i + j, "book", "a", f"k{i - j}", 10_000) for i in range(6) for j in (1, 0)][1:]
    rows = [(s, at, tie, kind, who, key, starts) for s, at, tie, kind, who, key, starts in rows]
    got = {r.tie: r.result for r in ledger.book_with_keys(spark.createDataFrame(rows, OPS), "slot", "at", 40, "tie").collect()}
    assert got == one_pass(rows, 40)


def test_no_operations(spark):
    assert ledger.book_with_keys(spark.createDataFrame([], OPS), "slot", "at", 40, "tie").count() == 0


def test_folds_keep_no_history_and_take_null_keys(spark):
    rows = spark.createDataFrame([(k, i) for i in range(6) for k in ("a", None)], "k string, at long").repartition(3)
    got = sorted((str(r.k), r.at, r.accepted) for r in ledger.sliding_limit(rows, ["k"], "at", 3, 1).collect())
    assert got == sorted((k, i, i % 3 == 0) for k in ("a", "None") for i in range(6))


def tree(found, width):
    """The anchor in plain Python."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {sha(str(o)): sha(f"{o}:{h}") for o, h in found.items()}
    digits = 0
    while width * 16**digits < len(level):
        digits += 1
    for d in range(digits, -1, -1):
        groups = {}
        for k, h in level.items():
            groups.setdefault(k[:d], []).append((k, h))
        level = {p: sha("\n".join(f"{k}:{h}" for k, h in sorted(g))) for p, g in groups.items()}
    return level.get("", sha(""))


def test_anchor_of_heads(spark):
    records = [(o, i, f"p{o}{i}") for i in range(4) for o in range(60) if (o + i) % 3]
    chain = ledger.build_chain(spark.createDataFrame(records, "o long, i long, p string").repartition(5), "o", "i", "p")
    chain = spark.createDataFrame(chain.collect(), chain.schema)
    upto = F.col("i") <= 2
    first = ledger.anchor(ledger.heads(chain, "o", "i", upto), "o", width=4).first()
    plain = {}
    for r in sorted(chain.where(upto).collect(), key=lambda r: r.i):
        plain[r.o] = r.hash
    assert tuple(first) == (60, tree(plain, 4))
    later = chain.union(spark.createDataFrame([(99, 0, 9, "new", "x", "y"), (1, 7, 9, "new", "x", "z")], chain.schema)).repartition(7)
    assert ledger.anchor(ledger.heads(later, "o", "i", upto), "o", width=4).first() == first
    assert ledger.anchor(ledger.heads(later, "o", "i"), "o", width=4).first() != first
    altered = chain.withColumn("hash", F.when((F.col("o") == 5) & (F.col("i") == 2), "0").otherwise(F.col("hash")))
    assert ledger.anchor(ledger.heads(altered, "o", "i", upto), "o", width=4).first().anchor != first.anchor
    assert tuple(ledger.anchor(ledger.heads(chain.limit(0), "o", "i"), "o").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_slots_as_a_stream_of_files(spark, tmp_path):
    rows = sorted(operations(7, 90), key=lambda r: (r[1], r[2]))
    rows.append((50, rows[-1][1] + 1, 500, "hold", "a", None, rows[-1][1] + 2000))
    source = str(tmp_path / "in")

    def arrive(part):
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(source)
        ops = spark.readStream.schema(OPS).parquet(source).withColumn("time", slots.from_seconds(F.col("at")))
        return slots.run_slots(spark, ops, 40, str(tmp_path / "out"), keep=5000).collect()

    arrive(rows[:30])
    arrive(rows[30:60])
    out = arrive(rows[60:])
    batch = {r.tie: r.result for r in ledger.apply_slot_operations(spark.createDataFrame(rows, OPS), "slot", "at", 40, "tie").collect()}
    assert {r.tie: r.result for r in out if r.kind != "timer"} == batch
    end = rows[-1][1] + 10_000
    done = arrive([(77, end, 1000, "hold", "a", None, end + 100)])
    # holds that nobody ended run out by themselves, each at its time; then the slots' states go
    held = {(r.slot, r.at + 40) for r in done if r.result == "held"}
    ended = {(r.slot, r.at) for r in done if r.result == "expired"}
    assert (50, rows[-1][1] + 40) in ended and ended <= held
    assert {r.slot for r in done if r.result == "dropped"} == {r[0] for r in rows}
    late = arrive([(77, end, 999, "book", "a", "k", end + 100)])
    assert [r.result for r in late if r.tie == 999] in (["late"], [])


def plain_resolve(mentions, names, budget):
    fold = lambda t: __import__("re").sub(r"(.)\1+", r"\1", t.lower().translate(str.maketrans(text.LEET_FROM, text.LEET_TO)))
    spent, out = {}, {}
    for doc, place, said in sorted(mentions):
        exact = [n for n in names if n.lower() == said.lower()]
        alike = [n for n in names if fold(n) == fold(said)]
        if exact or alike:
            out[doc, place] = (min(exact or alike), "exact" if exact else "folded")
            continue
        spent[doc] = spent.get(doc, 0) + 1
        if spent[doc] > budget:
            out[doc, place] = (None, "over_budget")
            continue
        near = sorted((-(1 - d / max(len(n), len(said))), n) for n in names if (d := text.osa(said.lower(), n.lower())) <= 2 and 1 - d / max(len(n), len(said)) >= 0.86)
        out[doc, place] = (near[0][1], "fuzzy") if near else (None, "unknown")
    return out


def test_cascade_with_a_budget(spark):
    names = ["cardiologist", "Surgeon", "dermatologist", "neurologist", "urologist", "anaesthesiologist"]
    said = ["CARDIOLOGIST", "surge0n", "dermatolgist", "nuerologist", "nothing here", "surgoen", "urologists", "anasthesiologsit", "cardioologist", "xurgeon", "neurologist"]
    mentions = [(d, p, s) for d in range(3) for p, s in enumerate(said[d:])]
    frame = spark.createDataFrame(mentions, "doc int, place int, said string").repartition(3)
    got = linking.resolve(frame, spark.createDataFrame([(n,) for n in names], "n string"), "doc", "place", "said", "n", budget=3)
    assert {(r.doc, r.place): (r.name, r.stage) for r in got.collect()} == plain_resolve(mentions, names, 3)
    rows = {r.stage: (r.rows_in, r.found) for r in linking.stage_rows(got).collect()}
    assert rows["exact"][0] == len(mentions) and rows["folded"][0] == len(mentions) - rows["exact"][1] and rows["fuzzy"][0] <= 9
