"""Removal of repeated word passages by prefix-partitioned suffix trees.

The suffixes of the distinct neighbourhoods (see repeats; units are words) are split by prefixes of
one, two, ... words until a group fits the limit; prefixes are as long as their group needs. Each
group's subtree is then grown a word a level: a node keeps the suffixes that agree so far, and
branches with one suffix are leaves and need no more words. Nodes WINDOW words deep with two or more
suffixes are the repeats; the suffix that starts first in the corpus stays.

Document order is (doc_id, null last; hash of the text); rows equal in both count as one document.
Nulls, empty texts and texts under WINDOW words remove nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import NO_ID, Block, Units, covered_ranges, refine
from .textkit import Words

WINDOW = 20
GRAM = 7
#: Suffixes that one subtree is built from; a prefix with more is made a word longer.
SUBTREE = 1 << 16
UNITS = Units(words=True, window=WINDOW, gram=GRAM)


def prefix_groups(start: np.ndarray, values: np.ndarray, depth: int, limit: int):
    """(prefix length, suffixes) of groups that share a prefix and number at most `limit`.

    A group that shares all `depth` words is one node however large it is.
    """
    todo = [(0, np.arange(len(start)))]
    while todo:
        d, group = todo.pop()
        if len(group) < 2:
            continue
        if d == depth or (d and len(group) <= limit):
            yield d, group
            continue
        word = values[start[group] + d]
        order = np.argsort(word, kind="stable")
        group, word = group[order], word[order]
        ends = np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, len(word))
        begin = 0
        while begin < len(word):  # deal out runs of whole branches
            k = int(np.searchsorted(ends, begin + limit, "right")) - 1
            end = int(ends[k]) if k >= 0 else 0
            if end > begin:
                yield d, group[begin:end]
            else:  # one branch above the limit
                end = int(ends[k + 1])
                todo.append((d + 1, group[begin:end]))
            begin = end


def suffix_tree_repeats(block: Block, units: Units, limit: int = SUBTREE) -> np.ndarray:
    """Which windows of the block's neighbourhoods have an equal one that comes before them."""
    who, start, _ = block.suffixes()
    hit = np.zeros(len(start), bool)
    for depth, group in prefix_groups(start, block.values, units.window, limit):
        live, node = group, np.zeros(len(group), np.int64)
        for d in range(depth, units.window):
            live, node = refine(live, node, block.values[start[live] + d])
            if not len(live):
                break
        if not len(live):
            continue
        rank = block.rank[who[live]]
        first = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, node, rank)
        hit[live[rank > first[node]]] = True
    return hit


DIGEST = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")


@F.pandas_udf(DIGEST)
def _digest(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for t, b, e in zip(text, begins, ends, strict=True):
        words, keep = kept_words(t, b, e)
        rows.append((len(words), len(words) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])


_SPACES = bytes([9, 10, 11, 12, 13])
_TO_SPACE = bytes.maketrans(_SPACES, b" " * 5)


def kept_words(text: str, begins, ends) -> tuple[list[bytes], list[bytes]]:
    """(words, words outside the windows that start in the ranges)."""
    words = [w for w in text.encode().translate(_TO_SPACE).split(b" ") if w]
    if begins is None or not len(begins):
        return words, words
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, begins, 1)
    np.add.at(mark, np.minimum(np.asarray(ends) + WINDOW - 1, len(words)), -1)
    stay = np.flatnonzero(np.cumsum(mark[:-1]) <= 0)
    return words, [words[i] for i in stay]


def later_repeats(docs: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges) of the places where a WINDOW-word sequence starts that started before."""
    return covered_ranges(docs, UNITS, suffix_tree_repeats, keep_first=True, **limits)


def repeat_digest(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    texts, found = later_repeats(docs.select("doc_id", "text"), **limits)
    joined = texts.join(found, ["dk", "th"], "left")
    cut = _digest("text", F.transform("spans", lambda x: x["s"]), F.transform("spans", lambda x: x["e"]))
    return joined.select(F.nullif(F.col("dk"), F.lit(NO_ID)).alias("doc_id"), cut.alias("c")).select("doc_id", "c.*")
