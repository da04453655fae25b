"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters and digits, and runs of other signs, as written; each goes by its hash into
one of BUCKETS rows. Every row has an index vector, made of its number: NONZERO places of DIMENSIONS
are 1 or -1. A row's context vector is the sum of the index vectors of the REACH tokens before and
after each of its tokens, over all texts of the corpus, whole. The sums are whole numbers, so they are
the same in any order; a task adds up its own texts and sends one row for each row that it met.

A document's features are means over its tokens: of their unit context vectors, of the same weighted
down for frequent tokens, of their index vectors, and of the products of neighbouring tokens' vectors
(which tell repetition), with the logarithm of its length. A network of two layers is trained on the
features of at most EXAMPLES labelled rows, chosen by hash of the id, in numpy on the driver: that many
rows of 4 * DIMENSIONS + 1 numbers. A quarter of them sets the temperature that calibrates its
probabilities and is not trained on. The table of vectors is BUCKETS * (2 * DIMENSIONS + 1) numbers at every
size and is broadcast.

Labels are learned only from rows whose crc32(id) mod FOLDS is not 0, and nothing but the text is an
input of a score. Label rows without id or label are ignored, several of an id count as the largest
label and, of several texts, the smallest. Null and empty texts have no tokens; they are scored as what
they are, all alike. Repeated documents are scored each. Without examples of both kinds every score is
the share of label 1 among the examples, or 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_or_empty
from .textkit import _BYTE, _SPACE, buffers, mix64, range_hashes, slices

FOLDS = 5
EXAMPLES = 12_000
BUCKETS = 1 << 15
DIMENSIONS = 32
NONZERO = 2
REACH = 2
#: Frequency at which a token's weight is halved.
FREQUENT = 1e-3
HIDDEN = 32
EPOCHS = 60
BATCH = 128
RATE = 0.004
DECAY = 1e-3
THRESHOLD = 0.3
#: Tokens whose vectors are held at a time, so that a long text takes no more memory than a short one.
CHUNK = 1 << 16

_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[_SPACE] = 0


def tokens(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, text) of every token."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    inside = kind[cut[:-1]] > 0
    start, end = cut[:-1][inside], cut[1:][inside]
    return (range_hashes(_BYTE[data], start, end) % np.uint64(buckets)).astype(np.int64), np.searchsorted(offsets, start, "right") - 1


def index_vectors(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of the NONZERO entries of each row's index vector; the places differ."""
    h = mix64(np.arange(buckets, dtype=np.uint64) + np.uint64(12))
    step = dimensions // NONZERO
    place = np.stack([(h >> np.uint64(8 * i)) % np.uint64(step) + np.uint64(i * step) for i in range(NONZERO)], 1).astype(np.int64)
    sign = np.stack([((h >> np.uint64(48 + i)) & np.uint64(1)).astype(np.int64) * 2 - 1 for i in range(NONZERO)], 1)
    return place, sign


CONTEXTS = "bucket int, n long, sums array<long>"


def _contexts(buckets: int, dimensions: int):
    """A task's counts and context sums of every row it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(buckets, dimensions)
        total, count = np.zeros(buckets * dimensions, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                row, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                count += np.bincount(row, minlength=buckets)
                for at in range(0, len(row), CHUNK):
                    for reach in range(1, REACH + 1):
                        here, there = slice(at, min(at + CHUNK, len(row) - reach)), slice(at + reach, at + reach + CHUNK)
                        same = doc[here] == doc[there]
                        left, right = row[here][same], row[there][same]
                        for a, b in ((left, right), (right, left)):
                            for c in range(NONZERO):
                                np.add.at(total, a * dimensions + place[b, c], sign[b, c])
        held = np.flatnonzero(count)
        sums = total.reshape(buckets, dimensions)
        for i in range(0, len(held), 8192):
            some = held[i : i + 8192]
            lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * dimensions, pa.array(sums[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists], names=["bucket", "n", "sums"])

    return run


def _added(dimensions: int):
    """Rows of the same bucket lie together: one row with their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch in batches:
            bucket, n = batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
            sums = batch.column("sums").flatten().to_numpy().reshape(-1, dimensions)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(order) else order
            if not len(first):
                continue
            for b, k, s in zip(bucket[order[first]].tolist(), np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0), strict=True):
                if b in known:
                    known[b][0] += k
                    known[b][1] += s
                else:
                    known[b] = [k, s.copy()]
        if known:
            lists = pa.ListArray.from_arrays(np.arange(len(known) + 1, dtype=np.int32) * dimensions, pa.array(np.concatenate([s for _, s in known.values()])))
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array([int(k) for k, _ in known.values()], pa.int64()), lists], names=["bucket", "n", "sums"])

    return run


def context_vectors(texts: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(bucket, n, sums) over all texts: how often each row occurs, and its context vector."""
    sent = texts.select("text").mapInArrow(_contexts(buckets, dimensions), CONTEXTS)
    return sent.repartition("bucket").mapInArrow(_added(dimensions), CONTEXTS)


@dataclass
class Vectors:
    """What pooling needs of every row, in single precision."""

    context: np.ndarray  # unit vectors
    own: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(table: pa.Table, buckets: int, dimensions: int) -> Vectors:
        context, count = np.zeros((buckets, dimensions)), np.zeros(buckets)
        for batch in table.to_batches():
            at = batch.column("bucket").to_numpy()
            count[at] = batch.column("n").to_numpy()
            context[at] = batch.column("sums").flatten().to_numpy().reshape(-1, dimensions)
        # logarithms of the sums' sizes, so that a few frequent neighbours don't make all of a vector
        context = np.sign(context) * np.log1p(np.abs(context))
        norm = np.sqrt((context**2).sum(1))
        context /= np.where(norm > 0, norm, 1)[:, None]
        own = np.zeros((buckets, dimensions), np.float32)
        place, sign = index_vectors(buckets, dimensions)
        for c in range(NONZERO):
            own[np.arange(buckets), place[:, c]] = sign[:, c] / np.sqrt(NONZERO)
        weight = FREQUENT / (FREQUENT + count / max(count.sum(), 1))
        return Vectors(context.astype(np.float32), own, weight.astype(np.float32))

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Features of each text."""
        buckets, dimensions = self.context.shape
        row, doc = tokens(data, offsets, buckets)
        n = len(offsets) - 1
        count = np.bincount(doc, minlength=n)
        out = np.zeros((n, 4 * dimensions + 1))
        out[:, -1] = np.log1p(count)
        for at in range(0, len(row), CHUNK):
            here = slice(max(at - 1, 0), at + CHUNK)  # with the token before, for the pairs
            vector, own, weight, text = self.context[row[here]], self.own[row[here]], self.weight[row[here]], doc[here]
            both = own + vector
            pair = np.zeros_like(own)
            np.multiply(both[1:], both[:-1], out=pair[1:])
            pair[1:][text[1:] != text[:-1]] = 0
            values = np.concatenate([vector, vector * weight[:, None], own, pair], axis=1)[at - here.start :]
            text = text[at - here.start :]
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            out[text[first], :-1] += np.add.reduceat(values, first, axis=0, dtype=np.float64)
        out[:, :-1] /= np.maximum(count, 1)[:, None]
        return out


@dataclass
class Network:
    """Two layers over standardised features, and the temperature of its logits."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
        """By Adam on the cross-entropy, with weight decay; the same rows in the same order give the same network."""
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        spread = x.std(0)
        net = Network(x.mean(0), np.where(spread > 1e-9, spread, 1), rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
        z = (x - net.mean) / net.spread
        weights = [net.w1, net.b1, net.w2, np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        batches = max(1, len(x) // BATCH)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for at in np.array_split(rng.permutation(len(x)), batches):
                hidden = np.tanh(z[at] @ weights[0] + weights[1])
                p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3][0], -50, 50)))
                error = (p - y[at]) / len(at)
                back = error[:, None] * weights[2] * (1 - hidden**2)
                step += 1
                for i, g in enumerate((z[at].T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()]))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g**2 - second[i])
                    moved = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    weights[i] -= rate * (moved + (DECAY * weights[i] if i in (0, 2) else 0))
        net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
        return net

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least cross-entropy, by golden section on its logarithm."""
        logit = self.logits(x)

        def loss(log_t: float) -> float:
            z = logit / np.exp(log_t)
            return float(np.mean(np.logaddexp(0, z) - y * z))

        low, high, part = np.log(0.2), np.log(20.0), (5**0.5 - 1) / 2
        for _ in range(50):
            a, b = high - part * (high - low), low + part * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _features(vectors: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                x = vectors.value.pooled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "label")), lists], names=["doc_id", "label", "x"])

    return run


def _scores(vectors: Broadcast, network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(np.diff(offsets)):
                x = vectors.value.pooled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(network.scores(x))], names=["doc_id", "score"])

    return run


def examples(docs: DataFrame, labels: DataFrame, label: str, limit: int = EXAMPLES) -> DataFrame:
    """(doc_id, label, text) of the labelled rows that are learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(_fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chosen, _ = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    # chosen: `limit` rows of two numbers at most
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[Broadcast, Network | float]:
    """(word vectors over all texts, network), or in place of the network the score that all documents get."""
    texts = docs.select(text_or_empty().alias("text"))
    table, path = materialise(context_vectors(texts))
    vectors = docs.sparkSession.sparkContext.broadcast(Vectors.of(table.toArrow(), BUCKETS, DIMENSIONS))  # BUCKETS rows at every size
    discard(docs.sparkSession, path)
    rows = examples(docs, labels, label).mapInArrow(_features(vectors), "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    y = rows.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return vectors, float(y.mean()) if len(y) else 0.0
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks]).reshape(len(y), -1)
    aside = mix64(rows.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(4) == 0
    if (aside & (y > 0)).sum() < 1 or (aside & (y == 0)).sum() < 1 or y[~aside].min() == y[~aside].max():
        return vectors, Network.train(x, y)
    network = Network.train(x[~aside], y[~aside])
    network.calibrate(x[aside], y[aside])
    return vectors, network


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    vectors, network = fit(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = texts.select("doc_id", F.lit(network).alias("score")) if isinstance(network, float) else texts.mapInArrow(_scores(vectors, network), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
