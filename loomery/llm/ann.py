"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Fitted on a bounded sample (SAMPLE vectors, by hash of the id): coarse centroids, and for each of
PARTS slices of the residuals a codebook of CODES entries. Every vector is indexed in the list of its
centroid. A query probes the lists of the largest inner products with the centroids; in each, an
asymmetric distance table gives approximate scores, and the RERANK best are scored exactly on the
original vectors. The k-th of those is a floor: an approximate score is off by no more than the sum over
the slices of the lengths of the query's part and of the vector's rounding, and every other vector that may
reach the floor is scored too. So a search loses nothing in the lists that it probes, however alike their
vectors are. How many lists are probed is measured on the sample, as the smallest number that
holds TARGET of the true neighbours. Then `recall` measures the result itself: CHECKED queries are
compared with all vectors, in blocks, and the probes grow by a half while less than LEAST of their neighbours
are found, or while that share less two standard errors is under SURE. A neighbour is found if the same row
is, not one with a score near its own, so that neither the vectors' scale nor ties hide a miss.

Lists are cut into blocks of at most BLOCK vectors by hash of the id, and the queries of a block into
parts, so a list or vector that holds a third of all rows is many small tasks. Only the vectors of
one block are in memory.

Vectors that are null, zero, of another dimension than most, or hold null or non-finite components
take no part. Equal vectors have equal codes, and ties go to the smaller id throughout, rows without
an id last; they are candidates and no queries. A query finds all candidates if there are fewer than k. Rows that repeat an id are queries and candidates of their own:
only a query's own row is no candidate of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .repeats import NO_ID

SAMPLE = 20_000
PARTS = 16
CODES = 64
BLOCK = 4096
QUERY_BLOCK = 4096
RERANK = 200
TARGET = 0.96
#: Queries whose neighbours are counted against brute force, and the share of them that must be found.
CHECKED = 256
LEAST = 0.92
SURE = 0.9
#: Rounding of an inner product in double precision, as a share of the lengths' product; and pairs scored at once.
ROUNDING = 1e-11
PAIRS = 1 << 17
K = 20


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        who = _nearest(x, centres)
        n = np.bincount(who, minlength=k)
        total = np.stack([np.bincount(who, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]  # a codebook for each slice
    cuts: list[int]
    probes: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.centres[lists]
        return np.stack([_nearest(residual[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def approximate(self, queries: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """Scores of queries x codes of one list, from a table of inner products a slice."""
        out = np.repeat((queries @ self.centres[which])[:, None], len(codes), axis=1)
        for p, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, p]]
        return out

    def slack(self, queries: np.ndarray, x: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """How far the approximate scores of queries x vectors may be off."""
        slices = list(zip(self.cuts, self.cuts[1:], self.books, strict=False))
        lost = np.stack([np.linalg.norm(x[:, a:b] - self.centres[which, a:b] - book[codes[:, p]], axis=1) for p, (a, b, book) in enumerate(slices)])
        part = np.stack([np.linalg.norm(queries[:, a:b], axis=1) for a, b, _ in slices], axis=1)
        length = np.linalg.norm(x, axis=1) + np.linalg.norm(self.centres[which])
        return part @ lost + ROUNDING * np.linalg.norm(queries, axis=1)[:, None] * length

    def order(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")


def fit(x: np.ndarray, lists: int, k: int = K, target: float = TARGET) -> Index:
    """An index from a sample; probes is measured on 400 of its rows as queries against all of it."""
    centres = k_means(x, lists)
    who = _nearest(x, centres)
    residual = x - centres[who]
    dim = x.shape[1]
    cuts = [round(dim * p / min(PARTS, dim)) for p in range(min(PARTS, dim) + 1)]
    books = [k_means(residual[:, a:b], CODES, seed=a + 2) for a, b in zip(cuts, cuts[1:], strict=False)]
    index = Index(centres, books, cuts, len(centres))
    queries = x[:400]
    exact = queries @ x.T
    exact[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argsort(-exact, axis=1)[:, :k]
    place = np.argsort(index.order(queries), axis=1)
    needed = np.take_along_axis(place, who[best], axis=1)
    index.probes = int(np.quantile(needed, target)) + 1
    return index


def usable(rows: DataFrame) -> DataFrame:
    """(key, vec_id, v): the vectors that take part, as doubles; key names the row, once this is written as a table."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v")).where("v is not null").where(fine)
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (common.d if common else 0)).select(F.monotonically_increasing_id().alias("key"), "vec_id", "v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


ROWS = "list int, part int, queries int, kind int, key long, id long, v binary, code binary"


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _tally(index: Index, dim: int, as_queries: bool):
    """How many vectors a list holds, or how many queries probe it, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index.centres), np.int64)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                x = _matrix(batch.column("v").slice(i, 1000), dim)
                lists = index.order(x)[:, : index.probes].ravel() if as_queries else index.lists(x)
                n += np.bincount(lists, minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], names=["list", "n"])

    return run


def _deal(index: Index, dim: int, parts: np.ndarray, query_parts: np.ndarray, as_queries: bool):
    """Vectors to every query part of their block, or queries to every block of the lists that they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1000):
                batch = whole.slice(i, 1000)
                x, keys, ids, salt = _matrix(batch.column("v"), dim), *(batch.column(c).to_numpy() for c in ("key", "vec_id", "salt"))
                if as_queries:
                    lists = index.order(x)[:, : index.probes].ravel()
                    row = np.repeat(np.arange(len(x)), index.probes)
                    copies, own = parts[lists], salt[row] % query_parts[lists]
                else:
                    lists = index.lists(x)
                    row = np.arange(len(x))
                    code = _binary(index.encode(x, lists))
                    copies, own = query_parts[lists], salt % parts[lists]
                again = np.repeat(np.arange(len(row)), copies)
                step = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                part, query = (step, own[again]) if as_queries else (own[again], step)
                at = pa.array(row[again])
                codes = pa.nulls(len(again), pa.binary()) if as_queries else code.take(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(z) for z in (lists[again].astype(np.int32), part.astype(np.int32), query.astype(np.int32), np.full(len(again), int(as_queries), np.int32), keys[row[again]], ids[row[again]])] + [_binary(x).take(at), codes],
                    names=["list", "part", "queries", "kind", "key", "id", "v", "code"],
                )

    return run


FOUND = "query long, query_id long, key long, vec_id long, score double"


def _exact(queries: np.ndarray, x: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """Inner products of the wanted pairs that may be among a row's k largest of them; -inf for the others.

    A matrix product tells which those are; each is then added up alike wherever it stands, so that ties stay ties.
    """
    out = np.full(wanted.shape, -np.inf)
    rough = np.where(wanted, queries @ x.T, -np.inf)
    off = ROUNDING * np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    n = len(x)
    floor = np.partition(rough - off, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
    q, at = np.nonzero(wanted & (rough + off >= floor))
    for i in range(0, len(q), PAIRS):
        a, b = q[i : i + PAIRS], at[i : i + PAIRS]
        out[a, b] = np.einsum("nd,nd->n", queries[a], x[b])
    return out


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, largest first, ties to the smaller column; -inf is none."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
    row, at = np.nonzero((score >= least) & (score > -np.inf))
    order = np.lexsort((at, -score[row, at], row))
    row, at = row[order], at[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], at[rank < k]


def _search(index: Index, dim: int, k: int, rerank: int):
    """Rows come block by block, vectors before queries."""

    def top(which, ids, keys, x, codes, query_ids, query_keys, queries):
        other = query_keys[:, None] != keys[None, :]
        score = np.where(other, index.approximate(queries, codes, which), -np.inf)
        first = np.ones(score.shape, bool)
        if len(ids) > max(rerank, k):
            first[:] = False
            np.put_along_axis(first, np.argpartition(-score, max(rerank, k) - 1, axis=1)[:, : max(rerank, k)], True, axis=1)
        exact = _exact(queries, x, first & other, k)
        if not first.all():
            floor = np.partition(exact, len(ids) - k, axis=1)[:, len(ids) - k, None]
            exact = np.maximum(exact, _exact(queries, x, ~first & other & (score + index.slack(queries, x, codes, which) >= floor), k))
        q, at = _best(exact, k)
        return pa.RecordBatch.from_arrays([pa.array(z) for z in (query_keys[q], query_ids[q], keys[at], ids[at], exact[q, at])], names=["query", "query_id", "key", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready = None, [], None
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy() for c in ("list", "part", "queries", "kind")], axis=1)
            cuts = np.flatnonzero((np.diff(block, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                which, kind = tuple(block[a, :3].tolist()), block[a, 3]
                ids, keys = (batch.column(c).to_numpy()[a:b] for c in ("id", "key"))
                x = np.frombuffer(b"".join(batch.column("v").slice(a, b - a).to_pylist()), np.float64).reshape(-1, dim)
                if which != key:
                    key, held, ready = which, [], None
                if kind == 0:
                    codes = np.frombuffer(b"".join(batch.column("code").slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                    held.append((ids, keys, x, codes))
                elif held:
                    if ready is None:
                        ready = [np.concatenate(z) for z in zip(*held, strict=True)]
                        order = np.lexsort((ready[1], ready[0]))  # by id, so that ties go to the smaller
                        ready = [z[order] for z in ready]
                    for i in range(0, b - a, 64):
                        yield top(key[0], *ready, ids[i : i + 64], keys[i : i + 64], x[i : i + 64])

    return run


def build(vectors: DataFrame, lists: int | None = None, k: int = K) -> Index | None:
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "key").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return None
    if lists is None:
        # forty sample vectors a list at least, and no more lists than twice the root of the rows
        lists = max(64, min(len(sample) // 40, round(2 * vectors.count() ** 0.5)))
    return fit(_matrix(sample, len(sample[0])), lists, k)


def search(vectors: DataFrame, queries: DataFrame, index: Index, k: int = K, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among vectors other than itself."""
    dim = index.centres.shape[1]

    def counts(df: DataFrame, as_queries: bool, size: int) -> np.ndarray:
        rows = df.select("v").mapInArrow(_tally(index, dim, as_queries), "list int, n long")
        n = np.ones(len(index.centres), np.int64)
        for r in rows.groupBy("list").agg(F.sum("n").alias("n")).collect():
            n[r["list"]] = -(-r["n"] // size)
        return n

    parts, query_parts = counts(vectors, False, BLOCK), counts(queries, True, QUERY_BLOCK)
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("vec_id", "key"), F.lit(1 << 40)))
    dealt = salted(vectors).mapInArrow(_deal(index, dim, parts, query_parts, False), ROWS).union(salted(queries).mapInArrow(_deal(index, dim, parts, query_parts, True), ROWS))
    block = ["list", "part", "queries"]
    found = dealt.repartition(*block).sortWithinPartitions(*block, "kind").mapInArrow(_search(index, dim, k, rerank), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query", "query_id", "rank", "key", "vec_id", "score")


def _every(queries: np.ndarray, keys: np.ndarray, dim: int, k: int):
    """The k nearest of each of a few queries in every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                x, found, ids = _matrix(batch.column("v"), dim), *(batch.column(c).to_numpy() for c in ("key", "vec_id"))
                order = np.lexsort((found, ids))
                x, found, ids = x[order], found[order], ids[order]
                score = _exact(queries, x, keys[:, None] != found[None, :], k)
                q, at = _best(score, k)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (keys[q], found[at], ids[at], score[q, at])], names=["query", "key", "vec_id", "score"])

    return run


def _recalls(vectors: DataFrame, queries: DataFrame, index: Index, k: int, checked: int, rerank: int) -> np.ndarray:
    """Share of the true k nearest that a search finds, of each of `checked` queries by hash."""
    some = queries.orderBy(F.xxhash64("key", "vec_id")).limit(checked).select("key", "vec_id", "v")
    some, path = materialise(some)
    rows = some.select("key", "v").toArrow()
    if not len(rows):
        return np.ones(0)
    dim = index.centres.shape[1]
    scores = vectors.select("key", "vec_id", "v").mapInArrow(_every(_matrix(rows.column("v").combine_chunks(), dim), rows.column("key").to_numpy(), dim, k), "query long, key long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "key")
    true = scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query", "key")
    found = search(vectors, some, index, k, rerank).select("query", "key", F.lit(1).alias("got"))
    shares = true.join(found, ["query", "key"], "left").groupBy("query").agg((F.count("got") / F.count(F.lit(1))).alias("share")).toArrow()
    discard(vectors.sparkSession, path)
    return shares.column("share").to_numpy()


def recall(vectors: DataFrame, queries: DataFrame, index: Index, k: int = K, checked: int = CHECKED, rerank: int = RERANK) -> float:
    """Share of the true k nearest that a search finds, for `checked` queries by hash against all vectors, in blocks."""
    shares = _recalls(vectors, queries, index, k, checked, rerank)
    return float(shares.mean()) if len(shares) else 1.0


def enough(shares: np.ndarray) -> bool:
    """Whether these queries' recalls show that all queries' together is SURE at least."""
    if not len(shares):
        return True
    return shares.mean() >= LEAST and shares.mean() - 2 * shares.std() / len(shares) ** 0.5 >= SURE


def nearest(rows: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """Queries: rows whose vec_id is divisible by `every`; candidates: every other row, those without an id too (last among ties)."""
    vectors, _ = materialise(usable(rows))
    index = build(vectors, k=k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.where((F.pmod("vec_id", F.lit(every)) == 0) & (F.col("vec_id") != NO_ID))
    while index.probes < len(index.centres) and not enough(_recalls(vectors, queries, index, k, CHECKED, RERANK)):
        index.probes = min(len(index.centres), index.probes + index.probes // 2 + 1)
    found = search(vectors, queries, index, k)
    return found.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
