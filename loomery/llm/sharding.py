"""Sharding by histogram sort: near equal bytes per shard, one exchange.

Rows are ordered by (hash of the text, hash of doc_id), so equal texts lie side by side. The exact
bytes below candidate boundaries are counted over all partitions; each round refines only the
intervals that hold a splitter, by the next BITS bits of the key, until a boundary is within the
tolerance. A cut prefers the edge of a group of equal texts and goes through a group, by the hash of
doc_id, only where the group is larger than the tolerance. Counting works on sizes and hashes; the
driver gets at most (shards - 1) * 2**BITS counts a round. One exchange then deals the rows out.

Rows equal in text and doc_id (null ids among them) are one row with a count until they are dealt out. Where
such a row is larger than the tolerance, the last part of its key is the number of the copy: copies have
one size, so the boundary among them is a division. A null text counts as empty (size 8); an empty table
gives no rows. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import gapless, materialise, own_names, spread, text_or_empty

SHARDS = 24
BITS = 10
KEY_BITS = 60
#: Rows that a cell of equal texts is meant to have at most.
CELL_ROWS = 20_000
#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.01


def keyed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hi, lo, copies): a row for each document, with the number of rows equal to it."""
    text = text_or_empty()
    mask = F.lit((1 << KEY_BITS) - 1)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(mask).alias("hi"),
        F.xxhash64(F.lit(1), F.col("doc_id")).bitwiseAND(mask).alias("lo"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


@dataclass
class _Search:
    """A splitter being looked for: target bytes, bytes below the interval, the group (once known), the interval."""

    target: float
    below: int = 0
    group: int | None = None
    interval: int = 0


def _histogram(rows: DataFrame, key: str, open_: list[_Search], shift: int) -> dict[tuple, list[Row]]:
    """Bytes of the cells of each open interval; a cell is the keys that agree above bit `shift`."""
    inside = F.lit(False)
    for group, interval in {(s.group, s.interval) for s in open_}:
        here = F.shiftright(key, shift + BITS) == interval
        inside |= here if group is None else here & (F.col("hi") == group)
    grouping = [F.shiftright(key, shift).alias("cell")] + (["hi"] if key == "lo" else [])
    found: dict[tuple, list[Row]] = {}
    weight = F.sum(F.col("size") * F.col("copies")).alias("bytes")
    counts = rows.where(inside).groupBy(*grouping).agg(weight, F.min(key).alias("least"), F.max(key).alias("most"), F.max("size").alias("unit"), F.max("copies").alias("copies"))
    for r in counts.collect():
        found.setdefault((r.hi if key == "lo" else None, r.cell >> BITS), []).append(r)
    return {k: sorted(v, key=lambda r: r.cell) for k, v in found.items()}


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """shards - 1 boundaries (hi, lo, copy); a row's shard is the number of boundaries not above its key."""
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    if not total:
        return [(1 << KEY_BITS, 0, 0)] * (shards - 1)
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int, int]] = {}
    groups: dict[int, _Search] = {}
    open_ = {s: _Search(total * s / shards) for s in range(1, shards)}
    for key in ("hi", "lo"):
        for shift in range(KEY_BITS - BITS, -1, -BITS):
            if not open_:
                break
            cells = _histogram(rows, key, list(open_.values()), shift)
            for s, x in list(open_.items()):
                for r in cells[x.group, x.interval]:
                    if x.below + r.bytes > x.target:
                        break
                    x.below += r.bytes
                else:
                    x.below -= r.bytes
                edge, one = (lambda k, g=x.group: (k, 0, 0) if g is None else (g, k, 0)), r.least == r.most
                low, high = x.target - x.below, x.below + r.bytes - x.target
                if min(abs(low), abs(high)) <= slack:
                    done[s] = edge(r.least if abs(low) <= abs(high) else r.most + 1)
                elif one and key == "lo":  # copies of one row above the tolerance: cut between two of them
                    done[s] = (x.group, r.least, max(0, min(r.copies, round(low / r.unit))))
                elif one:  # a group of equal texts above the tolerance: cut through it
                    groups[s] = _Search(x.target, x.below, r.least)
                else:
                    x.interval = r.cell
                    continue
                del open_[s]
        open_ = groups
    return [done[s] for s in range(1, shards)]


def shard_of(bounds: list[tuple[int, int, int]], copy: Column) -> Column:
    past = lambda hi, lo, n: (F.col("hi") > hi) | ((F.col("hi") == hi) & ((F.col("lo") > lo) | ((F.col("lo") == lo) & (copy >= n))))
    above = [past(*b).cast("int") for b in bounds]
    return sum(above[1:], above[0]) if above else F.lit(0)


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    rows, _ = materialise(keyed_sizes(docs))
    bounds = splitters(rows, shards, tolerance)
    # copies that a boundary parts, before and behind it
    cuts = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("hi", "lo", "n"), b, strict=True)]) for b in bounds if b[2]]) if any(b[2] for b in bounds) else None
    starts = F.array(F.lit(0).cast("long"))
    if cuts is not None:
        own = F.filter(cuts, lambda c: (c["hi"] == F.col("hi")) & (c["lo"] == F.col("lo")) & (c["n"] < F.col("copies")))
        starts = F.array_sort(F.array_union(starts, F.transform(own, lambda c: c["n"])))
    parts = rows.withColumn("starts", starts).select(*rows.columns, F.posexplode("starts").alias("i", "first"), "starts")
    parts = parts.withColumn("copies", F.coalesce(F.get("starts", F.col("i") + 1), F.col("copies")) - F.col("first")).drop("i", "starts")
    placed = parts.withColumn("shard", shard_of(bounds, F.col("first")).cast("int"))
    # as many cells of one text's rows as the count of rows asks, so that a text that is a third of them is dealt out too
    bits = max(4, (rows.count() // CELL_ROWS).bit_length())
    cells = [F.shiftright("hi", KEY_BITS - BITS), F.shiftright("lo", KEY_BITS - bits)]
    numbered = gapless(placed, ["shard"], ["hi", "lo", "doc_id", "first"], cells, "slot", "copies")
    numbered = spread(numbered, "copies", "copy", ["hi", "lo"]).withColumn("slot", F.col("slot") + F.col("copy"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """Write the documents themselves, a folder per shard, in one exchange by (shard, part of its key range).

    A column of theirs called shard is written as shard_. Where a boundary parts equal rows, each of them goes
    to either side by chance, in the boundary's proportion.
    """
    rows, _ = materialise(keyed_sizes(docs))
    bounds = splitters(rows, shards, tolerance)
    parted = {(hi, lo) for hi, lo, n in bounds if n}
    many = rows.where(F.lit(False)) if not parted else rows.where(F.struct("hi", "lo").isin([F.struct(F.lit(h), F.lit(lo)) for h, lo in parted]))
    held = {(r.hi, r.lo): r.copies for r in many.select("hi", "lo", "copies").collect()}  # a row a boundary at most
    copy = F.lit(0.0)
    for (h, lo), n in held.items():
        copy = F.when((F.col("hi") == h) & (F.col("lo") == lo), F.rand(7) * n).otherwise(copy)
    bits = max(3, (rows.count() // CELL_ROWS).bit_length())
    mask = F.lit((1 << KEY_BITS) - 1)
    keyed = docs.select(F.xxhash64(text_or_empty()).bitwiseAND(mask).alias("hi"), F.xxhash64(F.lit(1), F.col("doc_id")).bitwiseAND(mask).alias("lo"), F.struct(*docs.columns).alias("row"))
    placed = keyed.withColumn("copy", copy).withColumn("shard", shard_of(bounds, F.col("copy"))).repartition("shard", F.shiftright("lo", KEY_BITS - bits))
    names = own_names(docs.columns, ["shard"])
    placed.select("shard", *[F.col("row")[c].alias(n) for c, n in names.items()]).write.partitionBy("shard").parquet(path)
