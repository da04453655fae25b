"""Word vectors against counting, the network's gradient direction and calibration, held-out accuracy, odd input."""

import zlib

import numpy as np
import pytest

from loomery.llm import quality_classifier as qc

LABELS = "doc_id long, quality int, toxic int"


def split(text):
    """Tokens of a text in plain Python: runs of letters and digits (all other scripts' bytes among them), runs of other signs."""
    out, kind = [], None
    for b in (text or "").encode():
        k = 0 if b in b" \t\n\x0b\x0c\r" else 1 if b >= 128 or chr(b).isalnum() else 2
        if k and k == kind:
            out[-1] += bytes([b])
        elif k:
            out.append(bytes([b]))
        kind = k
    return out


def test_tokens_are_runs_of_one_kind():
    texts = ["ab,cd###  é1\t$$ x", "", "next", "a", " ", "$a$"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, doc = qc.tokens(data, offsets)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(split(t)) for t in texts]
    alone = [qc.tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for t in texts for w in split(t)]
    assert row.tolist() == alone


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_context_vectors(spark, make_docs, monkeypatch, chunk):
    monkeypatch.setattr(qc, "CHUNK", chunk)
    texts = ["a b c d e", "a b", None, "", "b a, b", "one", "a a a a"] * 3
    place, sign = qc.index_vectors(64, 8)
    index = np.zeros((64, 8), np.int64)
    for c in range(qc.NONZERO):
        index[np.arange(64), place[:, c]] += sign[:, c]
    sums, count = np.zeros((64, 8), np.int64), np.zeros(64, np.int64)
    for t in texts:
        rows = [int(qc.tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 64)[0][0]) for w in split(t)]
        for i, r in enumerate(rows):
            count[r] += 1
            for j in range(max(0, i - qc.REACH), min(len(rows), i + qc.REACH + 1)):
                if i != j:
                    sums[r] += index[rows[j]]
    got = {r.bucket: (r.n, list(r.sums)) for r in qc.context_vectors(make_docs(texts), 64, 8).collect()}
    assert got == {int(b): (int(count[b]), sums[b].tolist()) for b in np.flatnonzero(count)}


def test_pooling_does_not_depend_on_chunks_or_neighbours(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = qc.Vectors(rng.normal(size=(64, 8)).astype(np.float32), rng.normal(size=(64, 8)).astype(np.float32), rng.random(64).astype(np.float32))
    texts = [" ".join(rng.choice(list("abcdefgh,"), n)) for n in (5, 0, 1, 40, 7)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = vectors.pooled(data, offsets)
    alone = [vectors.pooled(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    monkeypatch.setattr(qc, "CHUNK", 4)
    assert np.allclose(whole, alone) and np.allclose(whole, vectors.pooled(data, offsets))
    assert not whole[1].any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))  # no line tells them apart
    y = (rng.random(3000) < p).astype(float)
    net = qc.Network.train(x[:1500], y[:1500])
    assert (net.logits(x[:1500]) == qc.Network.train(x[:1500], y[:1500]).logits(x[:1500])).all()
    before = net.scores(x[2200:])
    net.calibrate(x[1500:2200], y[1500:2200])
    after = net.scores(x[2200:])
    loss = lambda q: -np.mean(np.log(np.where(y[2200:] > 0, q, 1 - q)))
    assert loss(after) < loss(before) and loss(after) < 0.65
    high = after > 0.7
    assert abs(after[high].mean() - y[2200:][high].mean()) < 0.12


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = qc.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(1 - r.predicted for r in bad) / len(bad) > 0.8


def test_held_out_labels_are_not_learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in qc.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_odd_input(spark, make_docs):
    labels = lambda rows: spark.createDataFrame(rows, LABELS)
    docs = make_docs([None, "", "some words here", "$$$ ###", "x " * 50_000, "same", "same"])
    none = qc.quality_scores(docs, labels([])).collect()
    assert len(none) == 7 and {r.score for r in none} == {0.0}
    one = qc.quality_scores(docs, labels([(2, 1, 0), (None, 1, 0), (3, None, 0), (99, 1, 0)])).collect()
    assert {r.score for r in one} == {1.0}
    both = qc.quality_scores(docs.withColumnRenamed("lang", "score"), labels([(i, i % 2, 0) for i in range(7)] * 2)).collect()
    score = {r.doc_id: r.score for r in both}
    assert len(both) == 7 and score[0] == score[1] and abs(score[5] - score[6]) < 1e-12
    assert qc.quality_scores(make_docs([]), labels([(1, 1, 0)])).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "c")], "doc_id long, text string")
    got = qc.quality_scores(odd, labels([(4, 1, 0)])).collect()
    assert len(got) == 3 and [r.held_out for r in got if r.doc_id is None] == [False]
