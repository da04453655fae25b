"""Edit-aware token counts.

A text's pre-tokens are grouped into leaves of about LEAF characters, cut only where a pre-token must end
whatever stands further off: before blanks, and between letters, digits and other signs (but not after
an apostrophe, which may begin a contraction). No pre-token reaches over such a place and the pattern
looks at nothing behind it, so counts of leaves add up to the count of the text. A segment tree over the
leaves holds subtree sums. An edit re-encodes the leaves that it touches, with the neighbour whose cut it
might undo, replaces them in the tree and updates the sums above; the rest is not read again.

Trees are kept as a table, a row per document: `build_trees` makes it, `edit_trees` takes the table and one
of edits (doc_id, start, end, text) and gives the next one. A run of letters without any such place, as in
scripts that write no blanks, is one pre-token and stays one leaf.

Nulls and empty texts have no tokens and no leaves. Edits are (start, end, text) in characters of the
text before any of them, apart from one another; of edits that overlap the first stays, and what lies
beyond the end is cut to it. Edits of unknown documents are ignored, of repeated rows all get them; rows
of a null id get none. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, text_or_empty

LEAF = 512
#: Vocabulary of the counts; a parameter, read on the executors.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of that vocabulary's scheme: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


@lru_cache(maxsize=2)
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Where leaves begin, and the end: each at a safe cut, `leaf` characters on or later."""
    out, at = [0], 0
    while len(text) - at > leaf and (m := _CUT.search(text, at + leaf)):
        at = m.start()
        out.append(at)
    return [*out, len(text)] if text else [0]


class TokenTree:
    """Leaves of a text and their token counts, under a binary tree of sums of counts and lengths.

    Leaf slots that an edit merges away stay, empty; where an edit makes more leaves than it touched, the
    sums are laid out anew, without encoding any other leaf.
    """

    def __init__(self, text: str, count, leaf: int = LEAF):
        at = cuts(text, leaf)
        self.count, self.leaf = count, leaf
        leaves = [text[a:b] for a, b in zip(at, at[1:])]
        self.encoded = len(leaves)
        self._lay(leaves, [count(x) for x in leaves])

    @classmethod
    def of(cls, leaves: list[str], tokens: list[int], count, leaf: int = LEAF) -> TokenTree:
        """A tree from leaves that have been counted before."""
        tree = cls("", count, leaf)
        tree._lay(leaves, tokens)
        return tree

    @property
    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.size : self.size + len(self.leaves)]

    def _lay(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        spare = [0] * (self.size - len(leaves))
        self.tokens = [0] * self.size + tokens + spare
        self.lengths = [0] * self.size + [len(x) for x in leaves] + spare
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.lengths[i] = self.lengths[2 * i] + self.lengths[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf that holds a place, place inside it), by descent over lengths; the end is in the last."""
        i = 1
        while i < self.size:
            i *= 2
            if place >= self.lengths[i] and self.lengths[i + 1]:
                place -= self.lengths[i]
                i += 1
        return i - self.size, place

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.leaves[i] = text
        i += self.size
        self.tokens[i], self.lengths[i] = tokens, len(text)
        while i > 1:
            i //= 2
            self._sum(i)

    def _beside(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < len(self.leaves) and not self.leaves[i]:
            i += step
        return i if 0 <= i < len(self.leaves) else None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) of the text as it is now."""
        if not self.leaves:
            self._lay([""], [0])
        if start == end and not new:
            return
        first, inside = self._find(start)
        last, _ = self._find(max(start, end - 1))
        # a cut depends on the character before it and the two from it on
        if inside < 2 and (before := self._beside(first, -1)) is not None:
            inside += len(self.leaves[before])
            first = before
        stop = inside + end - start
        held = sum(len(self.leaves[i]) for i in range(first, last + 1))
        if held - stop < 2 and (after := self._beside(last, 1)) is not None:
            held += len(self.leaves[after])
            last = after
        joined = "".join(self.leaves[first : last + 1])
        joined = joined[:inside] + new + joined[stop:]
        # text shorter than a cut's context reaches over the next cuts
        while len(joined) < 3 and (after := self._beside(last, 1)) is not None:
            last = after
            joined += self.leaves[after]
        while len(joined) < 3 and (before := self._beside(first, -1)) is not None:
            first = before
            joined = self.leaves[before] + joined
        pieces = cuts(joined, self.leaf)
        pieces = [joined[a:b] for a, b in zip(pieces, pieces[1:])]
        old = {self.leaves[i]: self.tokens[self.size + i] for i in range(first, last + 1)}
        self.encoded += sum(p not in old for p in pieces)
        counted = [old[p] if p in old else self.count(p) for p in pieces]
        if len(pieces) > last + 1 - first:
            tokens = self.leaf_tokens
            self._lay(self.leaves[:first] + pieces + self.leaves[last + 1 :], tokens[:first] + counted + tokens[last + 1 :])
            return
        for k in range(last + 1 - first):
            piece, n = (pieces[k], counted[k]) if k < len(pieces) else ("", 0)
            if piece != self.leaves[first + k]:
                self._set(first + k, piece, n)

    def edit_all(self, edits: list[tuple[int, int, str]]) -> int:
        """Apply edits told in places of the text before any of them; how many were."""
        shift, end_before, n, length = 0, 0, 0, self.lengths[1]
        for start, end, new in sorted(edits, key=lambda e: e[:2]):
            start, end = min(start, length), min(max(start, end), length)
            if start < end_before:
                continue
            self.edit(start + shift, end + shift, new)
            shift += len(new) - (end - start)
            end_before, n = end, n + 1
        return n

    @property
    def text(self) -> str:
        return "".join(self.leaves)


#: Personal data that the registered query masks: addresses, phone numbers, IPv4 addresses.
MASKS = [(re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "[email]"), (re.compile(r"(?<!\w)\+?\d[\d ().-]{7,16}\d(?!\w)"), "[phone]"), (re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"), "[ip]")]


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    found = sorted((m.start(), m.end(), new) for pattern, new in MASKS for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, end, new in found:
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_leaves long, n_encoded_again long"


def _counts(edits, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        count = lambda x: len(encode(x))
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                tree = TokenTree(text := batch.column("text")[i].as_py(), count)
                before, leaves = tree.total, len(tree.leaves)
                encoded = tree.encoded
                done = tree.edit_all(edits(text))
                rows.append((before, done, tree.total, leaves, tree.encoded - encoded))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_leaves", "n_encoded_again"])

    return run


def edited_counts(docs: DataFrame, edits=mask_edits, ranks: str = RANKS) -> DataFrame:
    """Token counts of every document before and after its edits (a function of the text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_counts(edits, ranks), COUNTS)


TREES = "doc_id long, n_tokens long, leaves array<string>, tokens array<int>, n_encoded long"


def _tree_rows(ids: pa.Array, trees: list[TokenTree]) -> pa.RecordBatch:
    columns = [ids, pa.array([t.total for t in trees], pa.int64()), pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.leaf_tokens for t in trees], pa.list_(pa.int32())), pa.array([t.encoded for t in trees], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "leaves", "tokens", "n_encoded"])


def build_trees(docs: DataFrame, ranks: str = RANKS, leaf: int = LEAF) -> DataFrame:
    """The tree of every document: its token count, leaves, their counts, and how many leaves were encoded now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for whole in batches:
            for i in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(i, BATCH_ROWS)
                yield _tree_rows(batch.column("doc_id"), [TokenTree(t, lambda x: len(encode(x)), leaf) for t in batch.column("text").to_pylist()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, edits: DataFrame, ranks: str = RANKS, leaf: int = LEAF) -> DataFrame:
    """The trees after their edits (doc_id, start, end, text): only leaves that an edit touches are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for whole in batches:
            for i in range(0, len(whole), BATCH_ROWS):
                batch, made = whole.slice(i, BATCH_ROWS), []
                for leaves, tokens, todo in zip(*(batch.column(c).to_pylist() for c in ("leaves", "tokens", "todo")), strict=True):
                    tree = TokenTree.of(leaves, tokens, lambda x: len(encode(x)), leaf)
                    tree.edit_all([(e["start"], e["end"], e["text"] or "") for e in todo or ()])
                    made.append(tree)
                yield _tree_rows(batch.column("doc_id"), made)

    kinds = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col("start"), F.lit(0)).cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").cast("string").alias("text"))
    listed = kinds.where("start is not null and end is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("todo"))
    return trees.join(listed, "doc_id", "left").select("doc_id", "leaves", "tokens", "todo").mapInArrow(run, TREES)
