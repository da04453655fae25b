"""Packing into batches by optimal length buckets.

The global histogram of sequence lengths goes to the driver (at most `longest` of them), dynamic
programming there chooses the bucket boundaries that minimise padding, and token-budget batches form
inside each bucket: a batch of a bucket of length L holds budget // L sequences, each padded to L.

A text above `longest` words is cut into pieces of `longest`, so no sequence is dropped or cut short.
Nulls and empty texts have no tokens: they keep a row with piece 0, length 0 and no batch. Rows that
repeat are packed each on its own. Other columns are kept by `pack`; one that is named like a column
that it makes gets an underscore.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, gapless, materialise, own_names, text_or_empty

LONGEST = 2048
BUDGET = 16_384
BUCKETS = 16
#: Rows that are numbered together.
CELL_ROWS = 20_000
MADE = ["piece", "length", "bucket", "padded", "batch", "place"]


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """(upper lengths of at most `buckets` buckets, padding) with the least padding.

    cost[k][j] = min over i of cost[k-1][i] + (number in (i, j]) * length[j] - tokens in (i, j]. The
    best i never falls as j grows, so a layer is solved by divide and conquer.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(lengths)
    if not m:
        return [], 0
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    far = np.iinfo(np.int64).max // 4
    cost = np.full(m + 1, far)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        new[0] = 0
        todo = [(1, m, 0, m)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            value = cost[i] + (rows[j] - rows[i]) * lengths[j - 1] - (tokens[j] - tokens[i])
            best = int(np.argmin(value))
            new[j], cut[j] = value[best], i[best]
            todo += [(lo, j - 1, a, int(i[best])), (j + 1, hi, int(i[best]), b)]
        cost = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1], int(cost[m])


def sequences(docs: DataFrame, longest: int, keep: list[str]) -> DataFrame:
    """A row per piece: kept (a struct of columns), __id, __th (of doc_id and text), piece, length."""
    n = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*keep).alias("kept"), n.alias("__n"), F.col("doc_id").alias("__id"), F.xxhash64(text_or_empty(), "doc_id").alias("__th"))
    last = F.greatest(F.ceil(F.col("__n") / F.lit(longest)).cast("long") - 1, F.lit(0).cast("long"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return pieces.withColumn("length", F.least(F.col("__n") - F.col("piece") * longest, F.lit(longest).cast("long"))).drop("__n")


def pack(docs: DataFrame, keep: list[str], longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """Kept columns, piece, length, bucket (0 for no tokens), padded (length in the batch), batch, place."""
    rows, _ = materialise(sequences(docs, longest, keep))
    histogram = rows.where("length > 0").groupBy(F.col("length").alias("r")).agg(F.count(F.lit(1)).alias("c")).collect()  # at most `longest` lengths
    tops, _ = boundaries(np.array([r.r for r in histogram], np.int64), np.array([r.c for r in histogram], np.int64), buckets)
    bucket = F.when(F.col("length") <= 0, F.lit(0))
    padded = F.when(F.col("length") <= 0, F.lit(0).cast("long"))
    for i, top in enumerate(tops):
        bucket = bucket.when(F.col("length") <= top, F.lit(i + 1))
        padded = padded.when(F.col("length") <= top, F.lit(top).cast("long"))
    placed = rows.withColumns({"bucket": bucket.cast("int"), "padded": padded})
    bits = max(12, (rows.count() // CELL_ROWS).bit_length())
    mixed = placed.withColumn("__mix", F.xxhash64("__th", "piece"))
    numbered = gapless(mixed, ["bucket"], ["__mix", "length", "__id"], [F.shiftright("__mix", 64 - bits)], "__k")
    each = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1).cast("long"))
    out = numbered.withColumns({"batch": F.when(F.col("bucket") > 0, F.floor(F.col("__k") / each).cast("long")), "place": F.when(F.col("bucket") > 0, F.pmod(F.col("__k"), each).cast("int"))})
    return out.select(*[F.col("kept")[c].alias(n) for c, n in own_names(keep, MADE).items()], *MADE)


def pack_digest(docs: DataFrame) -> DataFrame:
    """doc_id, piece, length, bucket, padded, batch and place of every sequence."""
    return pack(docs.select("doc_id", "text"), ["doc_id"])
