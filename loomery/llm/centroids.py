"""Centroid clustering in whole numbers: screened in single precision, settled exactly.

Vectors become integers (floor of SCALE times each component), so every step has one right answer on
any number of machines. A round finds each vector's nearest centroid and replaces the centroids by the
floor of their vectors' means; sums are whole numbers and don't depend on their order.

Distances are screened first. |x - c|**2 is |x|**2 + (|c|**2 - 2 x.c), and x.c of all vectors and
centroids of a batch is one product of single-precision matrices. Whatever order it adds in, its error
is at most gamma * |x| |c| with gamma = d u / (1 - d u), u = 2**-24 (and two more roundings where a
component has over 24 bits), so each value lies in a known interval. A centroid whose interval begins
above the smallest upper end can't be nearest. Where one is left it is the answer; the others' squared
distances are computed again in 64-bit integers, and the smaller number wins a tie.

The driver holds the centroids and, each round, one sum for each of their components; everything else
stays in tasks. A task sends its sums once. The hottest cluster is summed where its vectors are.

Vectors that are null, have another number of components, or hold a null or non-finite one take no
part, nor do those with a component of 2**27 / SCALE or more, as their squared distance may not fit a
long. Repeated rows count each. A null vec_id is hashed as an empty one. Of vectors that share a hash
the one smaller in its components comes first; centroids may be equal, and then the later one stays
empty. With fewer vectors than CENTROIDS there are as many centroids as vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

CENTROIDS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Integers stay below this.
LIMIT = 1 << 27
#: Vectors of one matrix product.
CHUNK = 8192


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): v are the integers, of the vectors that take part."""
    limit = float(LIMIT) / scale
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions)).where(sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


@dataclass
class Nearest:
    """The nearest of some centroids (integers, a row each) to whole-number vectors."""

    centroids: np.ndarray

    def __post_init__(self):
        self.squares = (self.centroids.astype(np.int64) ** 2).sum(1)
        self.single = self.centroids.astype(np.float32)
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.exact_again = 0  # pairs computed in integers, for tests

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|**2 - 2 x.c of every vector and centroid."""
        d = x.shape[1]
        u = 2.0**-24
        terms = d + 2  # the products, their sums, and rounding of both inputs
        gamma = terms * u / (1 - terms * u)
        product = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        middle = self.squares.astype(np.float64) - 2 * product
        # the second part covers the double-precision steps of this bound and of `middle`
        slack = 2 * gamma * norms[:, None] * self.norms * (1 + 2.0**-20) + 2.0**-50 * (self.squares + 2 * np.abs(product))
        return middle - slack, middle + slack

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), CHUNK):
            part = x[i : i + CHUNK]
            low, high = self.intervals(part)
            open_ = low <= high.min(1)[:, None]
            best = open_.argmax(1)
            row, which = np.nonzero(open_ & (open_.sum(1) > 1)[:, None])
            if len(row):
                self.exact_again += len(row)
                distance = self.distances(part[row], which)
                order = np.lexsort((which, distance, row))
                first = order[np.concatenate(([True], np.diff(row[order]) != 0))]
                best[row[first]] = which[first]
            out[i : i + CHUNK] = best
        return out

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), CHUNK):
            apart = x[i : i + CHUNK].astype(np.int64) - self.centroids[which[i : i + CHUNK]]
            out[i : i + CHUNK] = np.einsum("ij,ij->i", apart, apart)
        return out


def _sums(nearest: Nearest):
    """A task's vectors counted and added up by cluster: rows (cluster, place, sum); place -1 has the count."""
    k, d = nearest.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            if not len(x):
                continue
            cluster = nearest.assign(x)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(cluster[order]) != 0)))
            total[cluster[order[first]]] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            count += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(count)
        if len(held):
            sums = np.concatenate([count[held, None], total[held]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, d + 1)), pa.array(np.tile(np.arange(-1, d), len(held))), pa.array(sums.ravel())], names=["cluster", "place", "sum"])

    return run


def _places(nearest: Nearest):
    d = nearest.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), d)
            cluster = nearest.assign(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(nearest.distances(x, cluster))], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(whole: DataFrame, centroids: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order: a top-k that keeps `centroids` rows a task."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(named.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()
    return np.array([r.v for r in rows], np.int64)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' componentwise floor of the mean; an empty one stays."""
    k, d = centroids.shape
    added = whole.mapInArrow(_sums(Nearest(centroids)), "cluster long, place long, sum long")
    # at most centroids * (components + 1) rows come back; decimals, as no sum of longs may overflow
    rows = added.groupBy("cluster", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    total = {(r["cluster"], r["place"]): int(r["sum"]) for r in rows}
    out = centroids.copy()
    for c in range(k):
        if n := total.get((c, -1)):
            out[c] = [total[c, p] // n for p in range(d)]
    return out


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, final centroids)."""
    spark = vectors.sparkSession
    whole, path = materialise(whole_vectors(vectors, dimensions, scale))
    now = first_centroids(whole, centroids, seed)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), now.reshape(0, dimensions)
    for _ in range(rounds):
        before, now = now, moved(whole, now)
        if (before == now).all():
            break  # all further rounds would do the same
    placed, _ = materialise(whole.mapInArrow(_places(Nearest(now)), "vec_id long, cluster int, distance long"))
    discard(spark, path)
    return placed, now


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    placed, found = cluster(vectors.select("vec_id", "embedding"))
    spark = vectors.sparkSession
    rows = placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row a centroid
    inertia = {r["cluster"]: r["s"] for r in rows}
    named = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found]
    told = spark.createDataFrame([(c, inertia.get(c), sum(inertia.values()), h) for c, h in enumerate(named)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT k.row, z.c, list_sum(list_transform(list_zip(k.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{r} z) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT z.c, coalesce(n.v, z.v) AS v FROM c{r} z LEFT JOIN (
    SELECT c, list(m ORDER BY i) AS v FROM (
      SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
        SELECT a.best.c AS c, g.i, sum(k.v[g.i])::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM a{r} a JOIN kept k USING (row), range(1, {dimensions + 1}) g(i) GROUP BY 1, 2)) GROUP BY c) n USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v FROM kept QUALIFY c < {centroids}),
{",".join(steps)},
placed AS (SELECT k.vec_id, a.best.c AS cluster, a.best.d AS distance FROM a{rounds} a JOIN kept k USING (row)),
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM placed GROUP BY 1)
SELECT p.vec_id, p.cluster, p.distance, s.cluster_inertia, (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia,
       sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM placed p JOIN sums s USING (cluster) JOIN c{rounds} z ON z.c = p.cluster
"""


ORACLE = _oracle()
