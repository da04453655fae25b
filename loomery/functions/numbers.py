"""Rounding, rates and histogram bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (ms) of the latency bins: fixed values. One more bin holds what is above.
LATENCY_BOUNDS = (5, 10, 25, 50, 75, 100, 150, 200, 250)


def half_up(x: Column) -> Column:
    """Round half up to a whole number, as floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def cents(x: Column) -> Column:
    """Money as whole hundredths, so that sums do not depend on their order."""
    return half_up(x * 100).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, null when the whole is 0."""
    return F.when(whole != 0, half_up(part * F.lit(1000.0) / whole) / F.lit(10.0))


def change(now: Column, before: Column) -> Column:
    """Percentage change to one decimal, null when there was nothing before."""
    return F.when(before != 0, half_up((now - before) * F.lit(1000.0) / before) / F.lit(10.0))


def bin_of(x: Column, bounds=LATENCY_BOUNDS) -> Column:
    """Number of the first bound that is not below x; one past the last for what is above all."""
    out = F.when(x <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(x <= b, i)
    return out.otherwise(len(bounds)).cast("int")


def band(n: Column, few: int = 5) -> Column:
    """Result-size band: zero, few or many."""
    return F.when(n == 0, "zero").when(n <= few, "few").otherwise("many")


def average(total: Column, n: Column) -> Column:
    """Average as a whole number, null for no rows."""
    return F.when(n > 0, half_up(total / n).cast("long"))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide: 32 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def split_of(key: Column, share: int = 3) -> Column:
    """test for one key in `share` by its hash, else train."""
    return F.when(F.floor(unit_hash(key) * share) == 0, "test").otherwise("train")


def distance_label(km: Column) -> Column:
    """Metres in steps of 50 below a kilometre (50 at least), one decimal below ten, whole kilometres above."""
    metres = F.greatest(half_up(km * 20) * 50, F.lit(50)).cast("int").cast("string")
    return F.when(km < 1, F.concat(metres, F.lit(" m"))).when(km < 10, F.concat(F.format_number(half_up(km * 10) / 10, 1), F.lit(" km"))).otherwise(F.concat(half_up(km).cast("int").cast("string"), F.lit(" km")))


def price_label(price: Column) -> Column:
    return F.when(price > 0, F.concat(F.lit("from "), half_up(price).cast("long").cast("string")))
