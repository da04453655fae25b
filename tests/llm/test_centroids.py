"""Clustering against whole-number arithmetic in plain Python: ties, empties, odd vectors, the screening bounds."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dimensions, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    now = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        sums = {}
        for _, v in kept:
            sums.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(sums[n]) for x in zip(*sums[n])] if n in sums else c for n, c in enumerate(now)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in placed:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in placed)


def digest(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_whole_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert digest(centroids.cluster_digest(vectors)) == brute(rows, 8, 10, 64)


def test_copies_nulls_odd_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=64).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, hot if i % 3 else rng.normal(size=64).astype(np.float32).tolist()) for i in range(90)]
    rows += [(None, rng.normal(size=64).astype(np.float32).tolist()), (7, rows[6][1]), (7, rows[6][1])]
    odd = [(200, None), (201, []), (202, hot[:63]), (203, [*hot, 1.0]), (204, [nan, *hot[1:]]), (205, [inf, *hot[1:]]), (206, [None, *hot[1:]])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster int").repartition(5)
    assert digest(centroids.cluster_digest(df)) == brute(rows, 8, 10, 64)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert digest(centroids.cluster_digest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))) == brute(rows, 8, 10, 64)
    assert centroids.cluster_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_centroids_leave_the_later_one_empty(spark):
    rows = [(i, [0.5] * 64) for i in range(40)] + [(100 + i, [0.5 + i / 1024] * 64) for i in range(4)]
    got = digest(centroids.cluster_digest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)))
    assert got == brute(rows, 8, 10, 64)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 64]), st.sampled_from([4, 1000, 1 << 26]), st.integers(1, 9))
def test_screening_never_rules_out_the_nearest(seed, d, size, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size, (50, d), dtype=np.int64)
    c = rng.integers(-size, size, (k, d), dtype=np.int64)
    c[k // 2] = c[0]  # a tie for certain
    x[:10] = (c[0] + c[-1]) // 2  # and near ties
    found = centroids.Nearest(c)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, z)) for z in c] for v in x]
    low, high = found.intervals(x.astype(np.int32))
    for v, row, lo, hi in zip(x, exact, low, high):
        own = sum(int(a) ** 2 for a in v)
        assert all(a <= e - own <= b for a, e, b in zip(lo.tolist(), row, hi.tolist()))
    assert found.assign(x.astype(np.int32)).tolist() == [min(range(k), key=lambda n: (row[n], n)) for row in exact]
    assert found.distances(x, np.zeros(len(x), np.int64)).tolist() == [row[0] for row in exact]


def test_few_pairs_are_computed_again():
    rng = np.random.default_rng(1)
    x, c = (rng.normal(0, 300, (n, 64)).astype(np.int32) for n in (2000, 8))
    found = centroids.Nearest(c.astype(np.int64))
    found.assign(x)
    assert found.exact_again < 20
