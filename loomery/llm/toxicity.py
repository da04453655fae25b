"""Toxicity by the nearest labelled examples under exact TF-IDF cosine over whole texts.

Terms are words (letters and digits, ASCII lower case), and word beginnings of the lengths in PREFIXES
where that names any. Every term of the labelled examples counts (at most EXAMPLES rows, chosen by hash
of the id), and document frequencies are counted over all documents. A term that toxic examples hold
more often than chance weighs (1 + sqrt(g)) ** STRENGTH times its TF-IDF, g being its log-likelihood
ratio; no term is left out. An example is normalised over its whole text. A query's length divides all
its cosines alike, so neither neighbours nor votes depend on it, and terms that no example holds need no
frequency.

The index is inverted over blocks of BLOCK examples that are alike in their common terms (those that
more than COMMON of the examples hold). Postings of the other terms are added up in full; of the common
terms only the largest weight in each block is, which bounds every example's cosine from above. The
examples with the k largest bounds are scored, and their k-th cosine is a floor under which no block is
opened. A text whose bounds leave more than OPEN examples gets its common terms as one matrix product.
All examples within the rounding bound of the k-th best are scored again in double precision, so the k
nearest are exact.

Neighbours vote by squared cosine, and the vote is calibrated: examples vote on each other, and a
non-decreasing fit (pool adjacent violators) of their labels on their votes gives the score. Texts
that share no term with an example get the examples' rate among texts without terms. Evidence is the
neighbours' ids.

Null and empty texts have no term. Label rows without id or label are ignored, several of an id count
as the largest label and, of several texts, the smallest; only rows whose crc32(id) mod FOLDS is not 0 are examples. Repeated documents
are scored each. Without examples every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .textkit import _BYTE, _LOWER, buffers, mix64, range_hashes, slices

FOLDS = 5
EXAMPLES = 12_000
PREFIXES: tuple[int, ...] = ()
#: Chosen with PREFIXES on two halves of the labelled rows outside the held-out fold.
STRENGTH = 1.5
#: Share of the examples above which a term is common, examples of a block, texts scored at once.
COMMON = 0.05
BLOCK = 32
CHUNK = 256
OPEN = 256
NEIGHBOURS = 15

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every occurrence of a term."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _TERM[data]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge], end[edge - 1] = inside[edge + 1], inside[edge]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    value = _BYTE[data]
    hashes, docs = [range_hashes(value, start, end)], [doc]
    if not PREFIXES:
        return hashes[0], doc
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    lead = np.append(lead, np.full(max(PREFIXES) + 1, n))
    at = np.searchsorted(lead, start)
    for p in PREFIXES:
        stop = lead[np.minimum(at + p, len(lead) - 1)]
        long = stop < end
        hashes.append(mix64(range_hashes(value, start[long], stop[long]) + np.uint64(p)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other examples of the batch hold each term."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy().astype(np.int64)
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(np.diff(offsets)):
            hashes, docs = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            _, once = np.unique(hashes ^ mix64(docs.astype(np.uint64)), return_index=True)
            named, where = np.unique(hashes[once], return_inverse=True)
            mark = toxic[i + docs[once]]
            yes = np.bincount(where, mark, minlength=len(named)).astype(np.int64)
            every = np.bincount(where, minlength=len(named))
            yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(yes), pa.array(every - yes)], names=["term", "yes", "no"])


class Vocabulary:
    """Sorted hashes, found by a table of where each run of equal leading bits begins."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __len__(self) -> int:
        return len(self.hashes)

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, hashes):
        self.hashes = hashes

    @cached_property
    def runs(self) -> tuple[np.uint64, np.ndarray]:
        """(bits to leave out, first place of each run)."""
        bits = min(22, max(1, len(self.hashes).bit_length() + 1))
        leading = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.uint64(64 - bits), np.searchsorted(self.hashes, leading).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are known, number of each of those)."""
        shift, first = self.runs
        place = first[hashes >> shift].astype(np.int64)
        last = len(self.hashes) - 1
        at = np.arange(len(hashes))
        for _ in range(4):  # most runs hold a hash or none
            at = at[(place[at] < last) & (self.hashes[np.minimum(place[at], last)] < hashes[at])]
            place[at] += 1
        at = at[self.hashes[place[at]] < hashes[at]]
        place[at] = np.searchsorted(self.hashes, hashes[at])
        place = np.minimum(place, last)
        known = np.flatnonzero(self.hashes[place] == hashes)
        return known, place[known]


def known_terms(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, count) in order."""
    hashes, docs = terms(data, offsets)
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    known, place = vocabulary.find(hashes)
    key, count = np.unique(docs[known] * len(vocabulary) + place, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count


def _frequencies(vocabulary: Broadcast):
    """In how many texts of the partition each term of the vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                _, term, _ = known_terms(vocabulary.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += np.bincount(term, minlength=len(total))
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "n"])

    return run


def _vectors(vocabulary: Broadcast):
    """Term numbers and counts of each example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                doc, term, count = known_terms(vocabulary.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cuts = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "toxic")), *lists], names=["doc_id", "toxic", "terms", "counts"])

    return run


@dataclass
class BlockMaxIndex:
    """Terms and counts of the examples end to end; what searches need besides is made where they run."""

    ids: np.ndarray
    labels: np.ndarray
    idf: np.ndarray  # weight of a term
    begin: np.ndarray  # terms of example e: begin[e] .. begin[e+1]
    term: np.ndarray
    count: np.ndarray

    @staticmethod
    def build(ids, labels, idf, rows: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        term, count = (np.concatenate([*(r[x] for r in rows), np.zeros(0, np.int32)]).astype(np.int32) for x in (0, 1))
        return BlockMaxIndex(np.asarray(ids), np.asarray(labels), idf, np.cumsum([0, *(len(t) for t, _ in rows)]), term, count)

    def __getstate__(self):
        """Gaps and counts by byte planes, compressed: every executor keeps a copy on disk."""
        planes = [zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T), 1) for x in (np.diff(self.term, prepend=np.int32(0)), self.count)]
        return self.ids, self.labels, self.idf, self.begin, planes

    def __setstate__(self, state):
        self.ids, self.labels, self.idf, self.begin, planes = state
        gap, self.count = (np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel() for x in planes)
        self.term = np.cumsum(gap, dtype=np.int32)

    @cached_property
    def weight(self) -> np.ndarray:
        """Unit vectors, in single precision."""
        w = self.idf[self.term] * (1 + np.log(self.count))
        example = np.repeat(np.arange(len(self.ids)), np.diff(self.begin))
        return (w / np.sqrt(np.bincount(example, w**2, len(self.ids)))[example]).astype(np.float32)

    @cached_property
    def place(self) -> dict[int, int]:
        return {d: i for i, d in enumerate(self.ids.tolist())}

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each common term or -1, weights by row and slot, largest weight by row and block)."""
        often = np.bincount(self.term, minlength=len(self.idf)) > COMMON * len(self.ids)
        row = np.where(often, np.cumsum(often) - 1, -1)
        at = np.flatnonzero(row[self.term] >= 0)
        blocks = -(-len(self.ids) // BLOCK)
        out = np.zeros((int(often.sum()), blocks * BLOCK), np.float32)
        out[row[self.term[at]], self.slot[self.example[at]]] = self.weight[at]
        return row, out, out.reshape(len(out), blocks, BLOCK).max(2)

    @cached_property
    def example(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.begin))

    @cached_property
    def slot(self) -> np.ndarray:
        """Place of each example in the blocks: by the heaviest of its most common terms, then by the weight that those have in it."""
        held = np.bincount(self.term, minlength=len(self.idf))
        at = np.flatnonzero(held[self.term] > COMMON * len(self.ids))
        share = np.bincount(self.example[at], self.weight[at] ** 2, len(self.ids))
        at = at[np.lexsort((self.weight[at], self.example[at]))]
        lead = np.zeros(len(self.ids), np.int64)
        lead[self.example[at]] = self.term[at]  # the last, so the heaviest, stays
        slot = np.empty(len(self.ids), np.int64)
        slot[np.lexsort((share, lead))] = np.arange(len(self.ids))
        return slot

    @cached_property
    def at_slot(self) -> np.ndarray:
        out = np.empty(len(self.slot), np.int64)
        out[self.slot] = np.arange(len(self.slot))
        return out

    @cached_property
    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first posting of each term and an end, slots, weights) of the other terms."""
        keep = np.flatnonzero(self.common[0][self.term] < 0)
        keep = keep[np.argsort(self.term[keep], kind="stable")]
        return np.searchsorted(self.term[keep], np.arange(len(self.idf) + 1)), self.slot[self.example[keep]], self.weight[keep]

    def search(self, cuts: np.ndarray, terms_: np.ndarray, counts: np.ndarray, k: int, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest with a cosine above 0 of texts cuts[i] .. cuts[i+1], ties to the smaller number; `without` is an example to leave out of each, or -1."""
        row, matrix, most = self.common
        begin, slots, weight = self.rare
        n = len(self.ids)
        slack = 4 * (len(matrix) + 4) * 2.0**-24  # of sums of unit vectors' products in single precision
        dense = np.zeros(len(self.idf))

        def others(t: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Cosines as far as the terms that are not common go."""
            held = begin[t + 1] - begin[t]
            at = np.repeat(begin[t] - np.cumsum(held) + held, held)
            at += np.arange(len(at))
            share = np.repeat(q, held)
            share *= weight[at]
            return np.bincount(slots[at], share, n)

        def exact(t: np.ndarray, q: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, source = _ranges(self.begin[near], self.begin[near + 1])
            dense[t] = q
            score = np.bincount(source, dense[self.term[at]] * self.weight[at], len(near))
            dense[t] = 0
            order = np.lexsort((near, -score))[:k]
            return near[order], score[order]

        for low in range(0, len(cuts) - 1, CHUNK):
            texts = range(low, min(low + CHUNK, len(cuts) - 1))
            table, queries = np.zeros((len(texts), len(matrix)), np.float32), []
            for i in texts:
                t = terms_[cuts[i] : cuts[i + 1]]
                q = weigh(self.idf, t, counts[cuts[i] : cuts[i + 1]])
                at = row[t]
                table[i - low, at[at >= 0]] = q[at >= 0]
                queries.append((t, q, at))
            bounds = table @ most
            found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
            left, partial = [], []
            for i, (t, q, at) in enumerate(queries):
                score = others(t[at < 0], q[at < 0])
                bound = score + np.repeat(bounds[i], BLOCK)[:n]
                if without[low + i] >= 0:
                    bound[self.slot[without[low + i]]] = 0
                if n > k:
                    first = np.argpartition(bound, n - k)[n - k :]
                    known = score[first] + table[i, at[at >= 0]] @ matrix[np.ix_(at[at >= 0], first)]
                    if without[low + i] >= 0:
                        known[first == self.slot[without[low + i]]] = 0
                    near = np.flatnonzero((bound >= known.min() - slack) & (bound > 0))
                else:
                    near = np.flatnonzero(bound > 0)
                if len(near) <= max(OPEN, k):
                    found[i] = self._positive(*exact(t, q, self.at_slot[near]))
                else:
                    left.append(i)
                    partial.append(score)
            scores = table[left] @ matrix
            for i, score, rest in zip(left, scores, partial, strict=True):
                t, q, _ = queries[i]
                score = score[:n] + rest
                if without[low + i] >= 0:
                    score[self.slot[without[low + i]]] = 0
                least = np.partition(score, n - k)[n - k] - slack if n > k else 0.0
                found[i] = self._positive(*exact(t, q, self.at_slot[np.flatnonzero((score >= least) & (score > 0))]))
            yield from found

    @staticmethod
    def _positive(examples: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return examples[score > 0], score[score > 0]

    def nearest(self, terms_: np.ndarray, counts: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self.search(np.array([0, len(terms_)]), terms_, counts, k, np.array([without])))

    def votes(self, cuts, terms_, counts, k: int, without: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(vote, ids of the nearest), -1 where there are none."""
        for best, score in self.search(cuts, terms_, counts, k, without):
            power = score**2
            yield (float((power * self.labels[best]).sum() / power.sum()) if len(best) else -1.0), self.ids[best]


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members of the ranges end to end, number of the range of each)."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) + (begin - np.cumsum(n) + n)[which], which


def weigh(idf: np.ndarray, terms_: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = idf[terms_] * (1 + np.log(counts))
    return w / np.sqrt((w**2).sum())


def strength(yes: np.ndarray, no: np.ndarray, n_yes: float, n_all: float) -> np.ndarray:
    """1, plus the root of the log-likelihood ratio of terms that toxic examples hold more often than chance, to the power STRENGTH."""
    expected = (yes + no) * (n_yes / n_all if n_all else 0.0)

    def part(observed: np.ndarray, chance: np.ndarray) -> np.ndarray:
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1) / np.maximum(chance, 1e-300)), 0.0)

    g = 2 * (part(yes, expected) + part(no, yes + no - expected))
    return (1 + np.where(yes > expected, np.sqrt(np.maximum(g, 0)), 0.0)) ** STRENGTH


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels, values) of the non-decreasing least-squares fit of y on x, each group smoothed by one row of the mean."""
    order = np.argsort(x, kind="stable")
    groups: list[list[float]] = []  # sum, number, largest x
    for a, b in zip(x[order], y[order], strict=True):
        if groups and groups[-1][2] == a:
            groups[-1][0] += b
            groups[-1][1] += 1
        else:
            groups.append([b, 1, a])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            s, n, a = groups.pop()
            groups[-1] = [groups[-1][0] + s, groups[-1][1] + n, a]
    mean = float(y.mean())
    return np.array([g[2] for g in groups]), np.maximum.accumulate(np.array([(g[0] + mean) / (g[1] + 1) for g in groups]))


@dataclass
class Model:
    vocabulary: Broadcast
    index: Broadcast
    levels: np.ndarray
    values: np.ndarray
    bare: float  # score of a text that shares no term with an example


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _votes(vocabulary: Broadcast, index: Broadcast, own: bool):
    """doc_id, vote and evidence of each text; `own` leaves an example out of its own neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                doc, term, count = known_terms(vocabulary.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = batch.column("doc_id").slice(i, j - i)
                without = np.array([found.place.get(d, -1) if own else -1 for d in ids.to_pylist()])
                cast = list(found.votes(np.searchsorted(doc, np.arange(j - i + 1)), term, count, NEIGHBOURS, without))
                yield pa.RecordBatch.from_arrays([ids, pa.array([v for v, _ in cast], pa.float64()), pa.array([e.tolist() for _, e in cast], pa.list_(pa.int64()))], names=["doc_id", "vote", "evidence"])

    return run


VOTES = "doc_id long, vote double, evidence array<long>"


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model | None]:
    """(doc_id and text of all documents, model)."""
    known = labels.where("doc_id is not null and toxic is not null").where(_fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen, _ = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # chosen: EXAMPLES rows of two numbers at most
    sample, _ = materialise(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_yes, n_all = float(totals[0] or 0), float(totals[1])
    if not n_all:
        return texts, None
    counted = sample.select("toxic", "text").mapInArrow(_count_terms, "term long, yes long, no long")
    marks = counted.groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).toArrow()
    hashes, yes, no = (marks.column(c).to_numpy() for c in ("term", "yes", "no"))
    order = np.argsort(hashes.view(np.uint64))
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary(hashes.view(np.uint64)[order]))

    counted = texts.select("text").mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(order))
    frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = (np.log((texts.count() + 1) / (frequency + 1)) + 1) * strength(yes[order], no[order], n_yes, n_all)

    rows = sample.mapInArrow(_vectors(vocabulary), "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow()
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy().astype(np.float64)
    vectors = [tuple(b.column(c)[r].values.to_numpy() for c in ("terms", "counts")) for b in rows.to_batches() for r in range(b.num_rows)]
    order = np.argsort(ids)
    ids, toxic, vectors = ids[order], toxic[order], [vectors[r] for r in order]
    del rows, marks, counted
    some = np.array([len(t) > 0 for t, _ in vectors])
    index = context.broadcast(BlockMaxIndex.build(ids[some], toxic[some], idf, [v for v, s in zip(vectors, some, strict=True) if s]))
    del vectors
    cast = sample.select("doc_id", "text").mapInArrow(_votes(vocabulary, index, True), VOTES).select("doc_id", "vote").toArrow().sort_by("doc_id")
    votes = cast.column("vote").to_numpy()
    rate = n_yes / n_all
    levels, values = isotonic(votes[votes >= 0], toxic[votes >= 0]) if (votes >= 0).any() else (np.zeros(1), np.array([rate]))
    return texts, Model(vocabulary, index, levels, values, float((toxic[~some].sum() + rate) / ((~some).sum() + 1)))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _votes(model.vocabulary, model.index, False)(batches):
            votes = batch.column("vote").to_numpy()
            score = np.where(votes < 0, model.bare, model.values[np.minimum(np.searchsorted(model.levels, votes), len(model.values) - 1)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), batch.column("evidence")], names=["doc_id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) of every document."""
    texts, model = fit(docs, labels)
    if model:
        scored = texts.mapInArrow(_scores(model), "doc_id long, score double, evidence array<long>")
    else:
        scored = texts.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("evidence"))
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
