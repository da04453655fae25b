"""Exactness of the nearest examples, terms and calibration, and held-out accuracy."""

import re
from zlib import crc32

import numpy as np

from loomery.llm import toxicity as tx


def brute_terms(text):
    out = []
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        out.append((0, w))
        chars = w.decode()
        out += [(p, chars[:p].encode()) for p in tx.PREFIXES if len(chars) > p]
    return out


def test_terms_match_plain_splitting():
    texts = ["Hello, wörld-wide webs!", "", "ABCDEFG abcdefg ééééééé", "x", " .. "]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes, docs = tx.terms(np.frombuffer(b"".join(raw), np.uint8), offsets)
    names = {}
    for i, t in enumerate(texts):
        want = brute_terms(t)
        assert (docs == i).sum() == len(want)
        alone, _ = tx.terms(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))
        assert sorted(hashes[docs == i].tolist()) == sorted(alone.tolist())
        for h, w in zip(sorted(set(alone.tolist())), sorted(set(want))):
            names.setdefault(h, w)
    assert len(set(hashes.tolist())) == len({w for t in texts for w in brute_terms(t)})


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 5, 60)

    def vector():
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        return t, rng.integers(1, 5, len(t))

    rows = [vector() for _ in range(700)]
    rows += rows[:50]
    index = tx.BlockMaxIndex.build(np.arange(750), rng.integers(0, 2, 750), idf, rows)
    dense = np.zeros((750, 60))
    for i, d in enumerate(index.ids):
        dense[i, rows[d][0]] = tx.weigh(idf, *rows[d])
    for _ in range(100):
        t, c = vector()
        q = np.zeros(60)
        q[t] = tx.weigh(idf, t, c)
        want = np.sort((dense @ q))[::-1][:15]
        best, score = index.nearest(t, c, 15)
        assert np.allclose(score, want[want > 0]) and np.allclose(dense[best] @ q, score)
    place = int(np.flatnonzero(index.ids == 0)[0])
    assert place not in index.nearest(*rows[0], 15, place)[0]


def test_isotonic_is_monotone():
    x = np.array([0.1, 0.2, 0.3, 0.3, 0.9])
    levels, values = tx.isotonic(x, np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(values) >= 0).all() and levels[-1] == 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = tx.toxicity(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert all(h == (crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted[held.toxic == 1].mean() > 0.8) and (held.predicted[held.toxic == 0].mean() < 0.03)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "some words"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == 3 and all(r.score == 0.0 and r.predicted == 0 for r in got)
    assert tx.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_neighbours_are_over_whole_texts(spark):
    """Few examples, marks shared with clean texts: evidence is the brute-force nearest under every term."""
    rng = np.random.default_rng(3)
    words = [f"word{i:02d}" for i in range(40)]
    texts = {i: " ".join(rng.choice(words[: 40 - 15 * (i % 2)], rng.integers(5, 30))) for i in range(60)}
    toxic = {i: i % 2 for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in tx.toxicity(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")).collect()}
    examples = [i for i in texts if crc32(str(i).encode()) % tx.FOLDS]
    every = {i: brute_terms(t) for i, t in texts.items()}
    names = sorted({t for i in examples for t in every[i]})
    n_yes = sum(toxic[i] for i in examples)
    yes, no = (np.array([sum(toxic[i] == y and t in every[i] for i in examples) for t in names]) for y in (1, 0))
    frequency = np.array([sum(t in e for e in every.values()) for t in names])
    weight = (np.log(61 / (frequency + 1)) + 1) * tx.strength(yes, no, n_yes, len(examples))
    counts = {i: np.array([e.count(t) for t in names]) for i, e in every.items()}
    vector = {i: weight * np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) for i, c in counts.items()}
    for i in texts:
        cosine = {e: vector[i] @ vector[e] / np.linalg.norm(vector[i]) / np.linalg.norm(vector[e]) for e in examples}
        assert len(got[i].evidence) == tx.NEIGHBOURS
        assert np.allclose([cosine[e] for e in got[i].evidence], sorted(cosine.values(), reverse=True)[: tx.NEIGHBOURS])


def test_examples_without_words_or_of_one_kind(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a b c", " ", None, "a b", "...", "a c d", "e"] * 3)], "doc_id long, text string")
    blank = [i for i in range(24) if i % 8 in (0, 2, 3, 5)]
    for ids, toxic in ((blank, 1), (range(24), 0), (range(24), 1), ([1], 1)):
        got = tx.toxicity(docs, spark.createDataFrame([(i, toxic) for i in ids], "doc_id long, toxic int")).collect()
        assert len(got) == 24 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        if len(list(ids)) == 24:
            assert {r.predicted for r in got} == {toxic}


def test_search_is_exact_with_many_open_blocks(monkeypatch):
    """Few, common terms: bounds stay loose, and the matrix product decides; many, rare ones: blocks are pruned."""
    rng = np.random.default_rng(7)
    for n_terms, opened in ((12, 8), (400, 8), (400, 10_000)):
        monkeypatch.setattr(tx, "OPEN", opened)
        idf = rng.uniform(1, 5, n_terms)
        rows = [(np.sort(rng.choice(n_terms, rng.integers(1, 9), replace=False)),) for _ in range(500)]
        rows = [(t, rng.integers(1, 5, len(t))) for (t,) in rows]
        index = tx.BlockMaxIndex.build(np.arange(500), rng.integers(0, 2, 500), idf, rows)
        dense = np.zeros((500, n_terms))
        for i, (t, c) in enumerate(rows):
            dense[i, t] = tx.weigh(idf, t, c)
        cuts = np.cumsum([0, *(len(t) for t, _ in rows[:300])])
        found = list(index.search(cuts, np.concatenate([t for t, _ in rows[:300]]), np.concatenate([c for _, c in rows[:300]]), 15, np.arange(300)))
        for i, (best, score) in enumerate(found):
            want = dense @ dense[i]
            want[i] = 0
            top = np.sort(want)[::-1][:15]
            assert i not in best and np.allclose(score, top[top > 0]) and np.allclose(want[best], score)


def test_vocabulary_finds_what_a_search_finds():
    rng = np.random.default_rng(4)
    many = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for held in (many, many[:1], np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        held = np.unique(held)
        asked = np.concatenate([held, held + np.uint64(1), held - np.uint64(1), many, np.array([0, 2**63, 2**64 - 1], np.uint64)])
        known, place = tx.Vocabulary(held).find(asked)
        assert known.tolist() == np.flatnonzero(np.isin(asked, held)).tolist()
        assert (held[place] == asked[known]).all()


def test_postings_are_added_up_once_a_text(monkeypatch):
    """Also of texts whose bounds leave so many examples that the matrix product decides."""
    monkeypatch.setattr(tx, "OPEN", 8)
    rng = np.random.default_rng(8)
    terms = [np.sort(np.concatenate([rng.choice(12, 6, replace=False), 12 + rng.choice(388, 4, replace=False)])) for _ in range(500)]
    rows = [(t, rng.integers(1, 5, 10)) for t in terms]
    index = tx.BlockMaxIndex.build(np.arange(500), rng.integers(0, 2, 500), rng.uniform(1, 5, 400), rows)
    begin, slots, weight = index.rare
    reads = []

    class Counted:
        def __getitem__(self, at):
            reads.append(len(at))
            return weight[at]

    index.__dict__["rare"] = (begin, slots, Counted())
    cuts = np.cumsum([0, *(len(t) for t, _ in rows[:300])])
    assert len(list(index.search(cuts, np.concatenate([t for t, _ in rows[:300]]), np.concatenate([c for _, c in rows[:300]]), 15, np.full(300, -1)))) == 300
    assert len(reads) == 300
