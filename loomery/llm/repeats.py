"""Finding what repeats across a corpus: the part that substring and suffix-array removal share.

A *window* is a run of L units (bytes or words) of one text. Of every window the smallest hash of
its k-unit strings is its *anchor* (the leftmost of equals), so equal windows have equal anchors at
equal places. Consecutive windows with one anchor make a *neighbourhood*. Windows whose anchor
occurs once in the corpus occur once themselves: only neighbourhoods of repeated anchors go on to
the suffix structures, each distinct one once, with the number and the first of its occurrences.

    texts -> anchors (one row per neighbourhood) -> anchors seen twice -> distinct neighbourhoods
          -> suffix array or suffix tree of each anchor's neighbourhoods -> covered ranges per text

A task holds one block of neighbourhoods (BLOCK_BYTES) at a time. An anchor with more than HOT_CLASSES
distinct neighbourhoods, which would not fit a block, is split by what stands around it: its windows
are dealt out by their whole content to as many parts as their number asks, and come in the order of
that content, so that a block can end between any two different windows. Where copies of one window
fill a block by themselves, the first of them is carried into the next block. A task that has sent such a
window sends no copy of it again: a copy is told as repeated at once, after its content was compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_or_empty
from .textkit import Words, buffers, byte_values, gram_hashes, range_hashes, sliding_argmin, slices

#: A text with more units than this is cut into overlapping parts for the anchors.
PART = 1 << 22
#: Distinct neighbourhoods of one anchor above which its windows are dealt out by content.
HOT_CLASSES = 4_000
#: Windows of such an anchor that a part is meant to have.
PART_WINDOWS = 4_000
#: Windows of hot anchors that a task remembers; older ones are forgotten, and then sent again.
REMEMBERED = 50_000
#: Parts over which those told at once are spread.
SPREAD = 1009
#: Neighbourhoods that one suffix structure holds at a time; its arrays take about 60 times this.
BLOCK_BYTES = 2 << 20
#: Stands for a null doc_id, which comes last in document order.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Units:
    """What a window counts: bytes, or words of 64-bit hashes."""

    words: bool
    window: int
    gram: int

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each unit, first unit of each text and the end)."""
        if not self.words:
            return byte_values(data), offsets
        w = Words(data, offsets)
        return w.hashes, w.first


def neighbourhoods(values: np.ndarray, first: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """(text, start in the text, windows, place of the anchor, anchor hash, content hash) of each."""
    out = []
    length, gram = units.window, units.gram
    if len(values) <= PART:
        parts = [(0, len(values))]
    else:
        parts = [(i, min(len(values), i + PART + length - 1)) for i in range(0, max(1, len(values) - length + 1), PART)]
    for i, j in parts:
        part = values[i:j]
        hashes = gram_hashes(part, gram)
        governs = sliding_argmin(hashes, length - gram + 1)
        if not len(governs):
            continue
        place = np.arange(i, i + len(governs))
        text = np.searchsorted(first, place, "right") - 1
        whole = np.flatnonzero(place + length <= first[text + 1])
        if not len(whole):
            continue
        anchor = governs[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(whole) != 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(whole)))
        lo = whole[at]
        content = range_hashes(part, lo, lo + count + length - 1)
        t = text[lo]
        out.append((t, lo + i - first[t], count, anchor[at] - lo, hashes[anchor[at]], content))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ANCHORS = "h long, fp long, dk long, th long, lo int, n int, lead int"


def _anchor_rows(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dk, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "th"))
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                base = offsets[i]
                values, first = units.read(data[base : offsets[j]], offsets[i : j + 1] - base)
                t, lo, n, lead, h, fp = neighbourhoods(values, first, units)
                if len(t):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (h.view(np.int64), fp.view(np.int64), dk[i + t], th[i + t], lo.astype(np.int32), n.astype(np.int32), lead.astype(np.int32))],
                        names=["h", "fp", "dk", "th", "lo", "n", "lead"],
                    )

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(dk, th, text): dk orders documents (doc_id, null last), dk and th together name one."""
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))


CONTENT = "h long, sub int, w long, fp long, dk long, th long, at int, off int, n int, content binary"


class _Sent:
    """The windows of hot anchors that a task has sent, so that copies need not be."""

    def __init__(self, keep_first: bool):
        self.keep_first = keep_first
        self.known: dict[tuple[int, int], list] = {}

    def add(self, h: int, w: int, place: tuple, fp: int, content: bytes) -> tuple[bool, list[tuple]]:
        """(whether to send it, windows (place, fp) now known to be repeated). A place is (dk, th, at, off)."""
        old = self.known.get((h, w))
        if old is None or old[2] != content:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[h, w] = [place, fp, content, False]
            return True, []
        if old[0] == place:  # a repeated input row
            return False, []
        if self.keep_first:
            if place > old[0]:
                return False, [(place, fp)]
            self.known[h, w] = [place, fp, content, False]
            return True, [(old[0], old[1])]
        told = [(place, fp)] + ([] if old[3] else [(old[0], old[1])])
        old[3] = True
        return False, told


def _content_rows(units: Units, keep_first: bool):
    """The units of the wanted neighbourhoods of each text; those of a hot anchor window by window. Rows with sub < 0 are windows known to be repeated."""
    schema = pa.schema([("h", pa.int64()), ("sub", pa.int32()), ("w", pa.int64()), ("fp", pa.int64()), ("dk", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("off", pa.int32()), ("n", pa.int32()), ("content", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent(keep_first)
        for batch in batches:
            rows = []
            held = 0
            data, offsets = buffers(batch.column("text"))
            for r, (dk, th, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dk", "th", "wanted")), strict=True)):
                raw = data[offsets[r] : offsets[r + 1]]
                if units.words:
                    raw = Words(raw, np.array([0, len(raw)])).hashes
                for x in wanted:
                    h, fp, lo, n, lead, parts = (x[c] for c in ("h", "fp", "lo", "n", "lead", "parts"))
                    around = raw[lo : lo + n + units.window - 1]
                    if not parts:
                        rows.append((h, 0, 0, fp, dk, th, lo + lead, -lead, n, around.tobytes()))
                        held += n + units.window
                    else:
                        told = gram_hashes(around if units.words else byte_values(around), units.window)
                        for c, (w, part) in enumerate(zip(told.view(np.int64).tolist(), (told % np.uint64(parts)).tolist(), strict=True)):
                            window = around[c : c + units.window].tobytes()
                            send, repeated = sent.add(h, w, (dk, th, lo + lead, c - lead), fp, window)
                            if send:
                                rows.append((h, 1 + part, w, fp, dk, th, lo + lead, c - lead, 1, window))
                                held += units.window
                            rows += [(h, -1 - (p[0] + p[2]) % SPREAD, 0, f, *p, 1, None) for p, f in repeated]
                    if held > 1 << 20 or len(rows) > 20_000:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


RANGES = "h long, fp long, s int, e int"


@dataclass
class Block:
    """Distinct neighbourhoods that lie together in one task: units end to end, and of each its place."""

    values: np.ndarray
    base: np.ndarray  # first unit of each neighbourhood in values
    anchor: np.ndarray  # dense number of its anchor
    off: np.ndarray  # its first window's distance from the anchor, 0 or less
    n: np.ndarray  # windows
    rank: np.ndarray  # its place in document order among the block's

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(neighbourhood, start in values, distance from the anchor) of every window."""
        who = np.repeat(np.arange(len(self.n)), self.n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        return who, self.base[who] + step, self.off[who] + step


def _solve(units: Units, repeated: Callable[[Block, Units], np.ndarray], block_bytes: int):
    """Ranges of repeated windows of the neighbourhoods dealt to a task, block by block of whole anchors."""

    def one(rows: pa.Table) -> pa.RecordBatch | None:
        h, sub, fp, dk, th, at, off, n = (rows.column(c).to_numpy() for c in ("h", "sub", "fp", "dk", "th", "at", "off", "n"))
        data, offsets = buffers(rows.column("content"))
        values = data if not units.words else data.view(np.uint64)
        base = offsets[:-1] // (8 if units.words else 1)
        key = np.ones(len(h), bool)
        key[1:] = (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])
        order = np.lexsort((at, th, dk))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (np.diff(dk[order]) != 0) | (np.diff(th[order]) != 0) | (np.diff(at[order]) != 0))))
        block = Block(values, base, np.cumsum(key) - 1, off.astype(np.int64), n.astype(np.int64), rank)
        hit = repeated(block, units)
        who, _, _ = block.suffixes()
        step = np.arange(len(who)) - (np.cumsum(n) - n)[who]
        edge = np.flatnonzero(hit)
        if not len(edge):
            return None
        new = np.ones(len(edge), bool)
        new[1:] = (np.diff(edge) != 1) | (who[edge[1:]] != who[edge[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(edge)) - 1
        w = who[edge[first]]
        s = step[edge[first]] + (off[w] if len(off) else 0)
        e = step[edge[last]] + off[w] + 1
        # ranges are told from the anchor, so that hot windows and whole neighbourhoods read alike
        return pa.RecordBatch.from_arrays([pa.array(h[w]), pa.array(fp[w]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["h", "fp", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not held:
                return
            rows = pa.concat_tables(held).combine_chunks()
            end, kept = len(rows), len(rows)
            if not final:  # the last anchor or window may go on in the next batch
                h, sub, w = (rows.column(c).to_numpy() for c in ("h", "sub", "w"))
                other = np.flatnonzero((h != h[-1]) | (sub != sub[-1]) | (w != w[-1]))
                kept = int(other[-1]) + 1 if len(other) else 0
                if kept or not sub[-1]:
                    end = kept
            # copies of one window that fill a block: the first of them stays for the next
            held = [rows.slice(kept, 1) if end > kept else rows.slice(kept)] if kept < len(rows) else []
            size = sum(t.nbytes for t in held)
            if end:
                out = one(_distinct(rows.slice(0, end)))
                if out is not None:
                    yield out

        for whole in batches:
            known = whole.column("sub").to_numpy() < 0
            if known.any():
                off = whole.column("off").to_numpy()[known]
                yield pa.RecordBatch.from_arrays([whole.column(c).filter(pa.array(known)) for c in ("h", "fp")] + [pa.array(off), pa.array(off + np.int32(1))], names=["h", "fp", "s", "e"])
            batch = whole.filter(pa.array(~known))
            for i in range(0, len(batch), 2000):
                part = pa.Table.from_batches([batch.slice(i, 2000)])
                held.append(part)
                size += part.nbytes
                if size > block_bytes:
                    yield from flush(False)
        yield from flush(True)

    return run


def _distinct(rows: pa.Table) -> pa.Table:
    """Rows sorted by anchor; a neighbourhood that came twice (repeated input rows) once."""
    h, sub, fp, off = (rows.column(c).to_numpy() for c in ("h", "sub", "fp", "off"))
    order = np.lexsort((off, fp, sub, h))
    h, sub, fp, off = h[order], sub[order], fp[order], off[order]
    keep = np.ones(len(order), bool)
    keep[1:] = (np.diff(h) != 0) | (np.diff(sub) != 0) | (np.diff(fp) != 0) | (np.diff(off) != 0)
    return rows.take(pa.array(order[keep])).combine_chunks()


def refine(live: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of each group by key and split the groups; suffixes left alone are settled."""
    order = np.lexsort((key, group))
    live, group, key = live[order], group[order], key[order]
    new = np.ones(len(live), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)[group] > 1
    return live[many], group[many]


def covered_ranges(docs: DataFrame, units: Units, repeated: Callable[[Block, Units], np.ndarray], keep_first: bool, hot_classes: int = HOT_CLASSES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): ranges has (dk, th, spans), spans of window starts [s, e) that are repeated.

    keep_first: only occurrences after the first one in document order count as repeated. Else every
    occurrence of a string that starts in two places does. `repeated` marks a block's windows: with
    keep_first those with an equal window of lower rank, else those with any equal one.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    anchors, scratch = materialise(texts.mapInArrow(_anchor_rows(units), ANCHORS))
    # as a table of its own, so that the join below has plain shuffles on both sides and a hot anchor is split
    again, again_path = materialise(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    occurrences, _ = materialise(anchors.join(again, "h", "left_semi"))
    discard(spark, scratch)
    discard(spark, again_path)

    classes = occurrences.groupBy("h", "fp").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("dk", "th", "lo", "n", "lead")).alias("f"))
    # tables, as above: one anchor may have a large share of all neighbourhoods
    classes, classes_path = materialise(classes)
    kinds, kinds_path = materialise(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("f.n").alias("windows")).where("k > 1"))
    parts = F.when(F.col("k") > hot_classes, F.ceil(F.col("windows") / PART_WINDOWS)).otherwise(F.lit(0)).cast("int")
    mixed = classes.join(kinds.select("h", parts.alias("parts")), "h").select("f.dk", "f.th", F.struct("h", "fp", "f.lo", "f.n", "f.lead", "parts").alias("x"))
    wanted = mixed.groupBy("dk", "th").agg(F.collect_list("x").alias("wanted"))
    content = texts.join(wanted, ["dk", "th"]).mapInArrow(_content_rows(units, keep_first), CONTENT)
    dealt = content.repartition("h", "sub").sortWithinPartitions("h", "sub", "w", "dk", "th", "at")
    solved = dealt.mapInArrow(_solve(units, repeated, block_bytes), RANGES)
    solved = solved.groupBy("h", "fp").agg(F.collect_set(F.struct("s", "e")).alias("some"))

    # a table as well: a neighbourhood that half of the occurrences share is split by the join below
    told, _ = materialise(classes.join(solved, ["h", "fp"], "left").where("m > 1 or some is not null"))
    discard(spark, classes_path)
    discard(spark, kinds_path)
    at = occurrences.join(told, ["h", "fp"])
    place = F.struct(F.col("dk"), F.col("th"), F.col("lo"))
    whole = place != F.struct("f.dk", "f.th", "f.lo") if keep_first else F.col("m") > 1
    all_of = F.array(F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("n")).alias("e")))
    part_of = F.transform("some", lambda x: F.struct((x["s"] + F.col("lo") + F.col("lead")).alias("s"), (x["e"] + F.col("lo") + F.col("lead")).alias("e")))
    found = at.select("dk", "th", F.explode(F.when(whole, all_of).otherwise(part_of)).alias("x"))
    return texts, found.groupBy("dk", "th").agg(F.collect_set("x").alias("spans"))
