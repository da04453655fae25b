"""Suffix-array removal of repeated bytes, by blockwise construction with a difference cover.

The suffixes of the distinct neighbourhoods (see repeats) are sorted one bucket at a time. A bucket
holds the suffixes that start at one distance from one anchor, so its members are congruent modulo
V. Ties longer than V bytes are not followed byte by byte: the ranks of a difference-cover sample of
the block, made once, settle the next L - V bytes in one comparison, and a last V bytes close the
window. Memory is that of one block (a few MB of text), however long the ties are and however many
neighbourhoods an anchor has (see repeats).

Nulls and empty texts remove nothing. Repeated rows are documents of their own. Other columns are
ignored by the query and kept by `cut_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty
from .repeats import NO_ID, Block, Units, covered_ranges, refine
from .textkit import runs

LENGTH = 200
V = 40
GRAM = 64


def difference_cover(v: int) -> list[int]:
    """A small set D such that every d below v is a difference, modulo v, of two members."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        best = max((x for x in range(1, v) if x not in cover), key=lambda x: len(open_ & {d % v for c in cover for d in (x - c, c - x)}))
        open_ -= {d % v for c in cover for d in (best - c, c - best)}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(V)
_IN_COVER = np.zeros(V, bool)
_IN_COVER[COVER] = True
#: From a place of residue r to the next one in the cover.
_TO_COVER = np.array([next(d for d in range(V) if _IN_COVER[(r + d) % V]) for r in range(V)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by keys, the first key weighing most; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_ = k[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(block: Block, eight: np.ndarray, length: int) -> np.ndarray:
    """For the places of the block's cover sample, the rank of their next length - V bytes.

    Ranks of V bytes are doubled: V is 0 modulo V, so a sample place plus V is in the sample again.
    """
    sizes = block.n + length - 1
    who = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(who))
    left = (block.base + sizes)[who] - place
    sample = place[_IN_COVER[(place - block.base[who] + block.off[who]) % V] & (left >= V)]
    ranks = np.zeros(len(place) + length, np.int64)
    ranks[sample] = _dense(*(eight[sample + b] for b in range(0, V, 8)))
    reach = V
    while 2 * reach <= length - V:
        sample = sample[left[sample] >= 2 * reach]
        ranks[sample] = _dense(ranks[sample], ranks[sample + reach])
        reach *= 2
    assert reach == length - V
    return ranks


def suffix_array_repeats(block: Block, units: Units) -> np.ndarray:
    """Which windows of the block's neighbourhoods have an equal one in another neighbourhood."""
    length = units.window
    who, start, off = block.suffixes()
    # Bytes are compared eight at a time, as big-endian numbers at every place.
    eight = np.ndarray((len(block.values),), ">u8", block.values.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    live = np.arange(len(start))
    live, group = refine(live, np.zeros(len(live), np.int64), (block.anchor[who] << 24) + off + (1 << 23))
    for b in range(0, V, 8):
        live, group = refine(live, group, eight[start[live] + b])
    if len(live):
        ranks = cover_ranks(block, eight, length)
        live, group = refine(live, group, ranks[start[live] + _TO_COVER[off[live] % V]])
    for b in range(length - V, length, 8):
        live, group = refine(live, group, eight[start[live] + b])
    hit = np.zeros(len(start), bool)
    hit[live] = True
    return hit


def _spans(size: int, begins, ends, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the windows that start in the ranges."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, begins, 1)
    np.add.at(mark, np.minimum(np.asarray(ends) + length - 1, size), -1)
    return runs(np.cumsum(mark[:-1]) > 0)


DIGEST = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")


@F.pandas_udf(DIGEST)
def _digest(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for t, b, e in zip(text, begins, ends, strict=True):
        raw = t.encode()
        if b is None or not len(b):
            rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
            continue
        first, last = _spans(len(raw), b, e, LENGTH)
        kept = hashlib.sha256()
        at = 0
        for f, g in zip(first.tolist(), last.tolist(), strict=True):
            kept.update(raw[at:f])
            at = g
        kept.update(raw[at:])
        rows.append((len(raw), int((last - first).sum()), len(first), kept.hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """The text without the runs, which are narrowed to whole characters."""
    out = []
    for t, b, e in zip(text, begins, ends, strict=True):
        if b is None or not len(b):
            out.append(t)
            continue
        raw = t.encode()
        inner = np.zeros(len(raw) + 1, bool)
        inner[:-1] = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
        kept, at = [], 0
        for f, g in zip(*(x.tolist() for x in _spans(len(raw), b, e, LENGTH)), strict=True):
            while inner[f]:
                f += 1
            while inner[g]:
                g -= 1
            if g > f:
                kept.append(raw[at:f])
                at = g
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


UNITS = Units(words=False, window=LENGTH, gram=GRAM)


def byte_repeats(docs: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges) of every place where a LENGTH-byte string starts that also starts elsewhere."""
    return covered_ranges(docs, UNITS, suffix_array_repeats, keep_first=False, **limits)


def repeat_digest(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    texts, found = byte_repeats(docs.select("doc_id", "text"), **limits)
    joined = texts.join(found, ["dk", "th"], "left")
    cut = _digest("text", F.transform("spans", lambda x: x["s"]), F.transform("spans", lambda x: x["e"]))
    return joined.select(F.nullif(F.col("dk"), F.lit(NO_ID)).alias("doc_id"), cut.alias("c")).select("doc_id", "c.*")


def cut_repeats(docs: DataFrame, **limits) -> DataFrame:
    """The documents, their other columns as they were, with repeated passages cut from the text."""
    _, found = byte_repeats(docs.select("doc_id", "text"), **limits)
    found = found.select("dk", "th", F.transform("spans", lambda x: x["s"]).alias("s"), F.transform("spans", lambda x: x["e"]).alias("e"))
    text = text_or_empty()
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    joined = marked.join(found, ["dk", "th"], "left").withColumn("new", F.when(F.col("s").isNull(), F.col("text")).otherwise(_cut("text", "s", "e")))
    return joined.select(*[F.col("new").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
