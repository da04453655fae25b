"""Quality rules with suffix-array repetition.

Of each document the suffix array of its words is built over the suffixes that can matter (those
whose first MIN_REPEAT words occur again in the text; all others have shorter common prefixes). The
longest-common-prefix values between neighbours give every suffix its deepest LCP interval, that is
the longest string that starts there and repeats. The spans of these maximal repeats are united: a
document fails if they cover too large a share of its words, or if the longest is too large a share.

Nulls and empty texts have no words, so they fail the base rule on length. Repeated rows get equal
verdicts; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_struct
from .textkit import Words, buffers, byte_values, covered, gram_hashes, mix64, range_hashes, slices

#: Base rules, as the contract has them.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: The method's own limits.
MIN_REPEAT = 5
MAX_COVERED = 0.40
MAX_LONGEST = 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k words occur twice or more in their text, and a number for each such string."""
    if len(words.hashes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = words.doc[: len(words.hashes) - k + 1]
    whole = np.flatnonzero(doc == words.doc[k - 1 :])
    key = gram_hashes(words.hashes, k)[whole] ^ mix64(doc[whole].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(key[order]) != 0
    number = np.cumsum(new) - 1
    many = np.bincount(number, minlength=1)[number] > 1
    place, number = whole[order[many]], number[many]
    order = np.argsort(place)
    return place[order], number[order]


def _first_ranks(words: Words, end: np.ndarray, k: int) -> np.ndarray:
    """For every word the number of suffixes that come before its own, by text and the next k words; equal ones share it.

    Words are in the order of their hashes, which is as good as any, and a text's end comes before every word.
    """
    n = len(words.hashes)
    _, number = np.unique(words.hashes, return_inverse=True)
    number = np.append(number.astype(np.int64) + 1, np.zeros(k, np.int64))
    place = np.arange(n)
    ahead = [np.where(place + j < end, number[place + j], 0) for j in range(k)]
    bits = int(number.max()).bit_length()
    keys, each = [words.doc], max(1, 62 // bits)
    for i in range(0, k, each):
        packed = ahead[i]
        for x in ahead[i + 1 : i + each]:
            packed = (packed << bits) | x
        keys.append(packed)
    order = np.lexsort(keys[::-1])
    new = np.zeros(n, bool)
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    return rank


def repeat_lengths(words: Words, k: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(places, length in words of the longest string from there that occurs again in the text).

    The suffixes are ranked by their first k words, and by prefix doubling those that tie by 2k, 4k, ...
    A rank is the number of suffixes before, so those that are settled keep theirs. The ranks of each
    round then measure the common prefixes of neighbours in suffix-array order.
    """
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = words.first[words.doc + 1]
    level = _first_ranks(words, end, k)
    place = np.flatnonzero(np.bincount(level, minlength=n)[level] > 1)
    if not len(place):
        return place, place
    levels, reach = [level], k
    while True:
        ahead = np.where(place + reach < end[place], level[np.minimum(place + reach, n - 1)], -1)
        order = np.lexsort((ahead, level[place]))
        a, b = level[place[order]], ahead[order]
        at = np.arange(len(order))
        group, head = np.ones(len(order), bool), np.ones(len(order), bool)
        group[1:] = a[1:] != a[:-1]
        head[1:] = group[1:] | (b[1:] != b[:-1])
        level = level.copy()
        level[place[order]] = a + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        if head.all():
            break
        levels.append(level)
        reach *= 2
    suffix = place[order]
    last = end[suffix]
    p, q = suffix[:-1].copy(), suffix[1:].copy()
    common = np.zeros(len(p), np.int64)
    inside = lambda: (p < last[:-1]) & (q < last[1:])
    for i in range(len(levels) - 1, -1, -1):
        equal = inside() & (levels[i][np.minimum(p, n - 1)] == levels[i][np.minimum(q, n - 1)])
        step = (k << i) * equal
        common += step
        p, q = p + step, q + step
    open_ = common > 0
    for _ in range(k - 1):  # the rest is shorter than k
        open_ &= inside()
        open_ &= words.hashes[np.minimum(p, n - 1)] == words.hashes[np.minimum(q, n - 1)]
        common += open_
        p, q = p + open_, q + open_
    longest = np.zeros(len(suffix), np.int64)
    longest[:-1] = common
    longest[1:] = np.maximum(longest[1:], common)
    return suffix, longest


FIELDS = T.StructType()
for _name, _kind in [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("covered_words", "long"), ("longest_repeat", "long"), ("base_failed", "boolean"), ("kept", "boolean")]:
    FIELDS = FIELDS.add(_name, _kind)


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The fields for a batch of texts."""
    docs = len(offsets) - 1
    words = Words(data, offsets)
    n_words = words.counts
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.subtract.at(inside, words.ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    word_chars = _sums(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = _sums(_SYMBOL[data], offsets)
    # lines: from each text's start or line feed to the next
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], cut + 1)))
    ends = np.sort(np.concatenate((offsets[1:], cut)))
    has_word = np.concatenate(([0], np.cumsum(inside)))
    full = has_word[ends] > has_word[starts]
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    lines = range_hashes(byte_values(data), starts, ends) ^ mix64(line_doc.astype(np.uint64)) if len(data) else np.zeros(0, np.uint64)
    _, once = np.unique(lines, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[once], minlength=docs)
    again, _ = _again(words, REPEAT_WINDOW)
    repeat_words = _sums(covered(again, REPEAT_WINDOW, len(words.hashes)), words.first)
    place, length = repeat_lengths(words)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, words.doc[place], length)
    mark = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(mark, place, 1)
    np.add.at(mark, place + length, -1)
    covered_words = _sums(np.cumsum(mark[:-1]) > 0, words.first)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    kept = ~base_failed & (covered_words <= MAX_COVERED * n_words) & (longest <= MAX_LONGEST * n_words)
    return [n_words, word_chars, symbols, dup_lines, repeat_words, covered_words, longest, base_failed, kept]


def _fields(text: pa.Array) -> list[np.ndarray]:
    data, offsets = buffers(text)
    parts = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(np.diff(offsets))]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7 + [np.zeros(0, bool)] * 2


def with_quality(docs: DataFrame, name: str = "quality") -> DataFrame:
    """docs with a struct column of the measures and the verdict."""
    return with_struct(docs.withColumn("text", F.col("text").cast("string")), name, FIELDS, _fields)


def quality_digest(docs: DataFrame) -> DataFrame:
    return with_quality(docs.select("doc_id", "text")).select("doc_id", "quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return with_quality(rows).where("quality.kept").select("row.*")
