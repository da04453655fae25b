"""Search against brute force: exact scores, ties, odd vectors, recall."""

import numpy as np

from loomery.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(x, ids, query, k):
    score = {i: float(np.dot(x[n], x[ids.index(query)])) for n, i in enumerate(ids) if i != query}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


def test_recall_and_exact_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = rows.toPandas()
    x = {i: np.array(v, np.float64) for i, v in zip(data.vec_id, data.embedding)}
    ids = list(x)
    m = np.array([x[i] for i in ids])
    found = {}
    for r in ann.nearest(rows).collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12 and r.query_id != r.vec_id
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(got, got[1:]))
        hits += len({g[1] for g in got} & set(brute(m, ids, q, 20)))
    assert hits / (20 * len(found)) >= 0.9


def test_hot_vector_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(600)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect() if r.query_id in (20, 40)]
    copies = [i for i in range(600) if i % 3]
    for q in (20, 40):
        assert [v for a, _, v in sorted(got) if a == q] == [c for c in copies if c != q][:20]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (20, [0.5, 1.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [1.0], 0), (None, [1.0, 1.0], 0), (7, [-1.0, 3.0], 0)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 7, 5.0), (0, 2, None, 3.0), (0, 3, 20, 2.5), (20, 1, 0, 2.5), (20, 2, 7, 2.5), (20, 3, None, 1.5)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_queries_and_candidates(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(40)}
    rows = [(i, v, 0) for i, v in vectors.items()] + [(0, vectors[0], 0), (20, vectors[20], 0)]
    x = {i: np.array(v, np.float64) for i, v in vectors.items()}
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 20):
        ids = [*(i for i in x if i != q), q, *({0, 20} - {q})]  # the twin is a candidate, and so is the other's
        want = sorted(ids, key=lambda i: (-float(x[i] @ x[q]), i))[:20]
        assert sorted(got[q]) == sorted([(n + 1, i) for n, i in enumerate(want)] * 2)


def test_recall_is_measured(spark, sf):
    vectors, _ = ann.materialise(ann.usable(spark.read.parquet(f"{sf}/embeddings.parquet")))
    index = ann.build(vectors)
    queries = vectors.where("vec_id % 20 = 0")
    index.probes = len(index.centres)
    assert ann.recall(vectors, queries, index) > 0.99
    index.probes = 1
    assert ann.recall(vectors, queries, index) < 0.5


def test_rows_without_an_id_are_candidates_and_last_among_ties(spark):
    rows = [(0, [1.0, 0.0], 0), (None, [9.0, 1.0], 0), (None, [2.0, 1.0], 0), (5, [2.0, 3.0], 0), (1, [2.0, 0.0], 0)]
    got = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert got == [(1, None, 9.0), (2, 1, 2.0), (3, 5, 2.0), (4, None, 2.0)]


def clustered(rng, n, clusters, noise, dim=32):
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dim)) / dim**0.5


def test_queries_unlike_the_rows_at_any_scale(spark):
    """Probes that suit the rows are too few for such queries; scores far below 1e-9 must not hide that."""
    rng = np.random.default_rng(11)
    x = clustered(rng, 3000, 40, 0.01)
    x[::20] = rng.normal(size=(150, 32)) / 32**0.5
    for scale in (1.0, 1e-6):
        tables = [(i, v, 0) for i, v in enumerate((scale * x).astype(np.float32).tolist())]
        m = np.array([v for _, v, _ in tables])
        got = ann.nearest(spark.createDataFrame(tables, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len(found[q] & set(brute(m, list(range(3000)), q, 20))) for q in range(0, 3000, 20))
        assert hits / (20 * 150) >= 0.9


def test_nothing_is_lost_in_probed_lists_of_many_alike(spark):
    """Vectors alike within the rounding of their codes, far more than are reranked."""
    rng = np.random.default_rng(12)
    x = clustered(rng, 4000, 4, 0.3)
    x[1::2] = x[1] + 1e-3 * rng.normal(size=(2000, 32))
    x[3::400] = x[7]
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    vectors, _ = ann.materialise(ann.usable(rows))
    index = ann.build(vectors, lists=6)
    index.probes = len(index.centres)
    queries = vectors.where("vec_id % 100 = 0 or vec_id % 100 = 1")
    assert ann.recall(vectors, queries, index, rerank=25) == 1.0
    found = {}
    for r in ann.search(vectors, queries, index, rerank=25).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, got in found.items():
        assert [v for _, v in sorted(got)] == brute(x, list(range(4000)), q, 20)
    assert len(found) == 80
