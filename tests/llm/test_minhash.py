"""Near-duplicates against brute force over all pairs, and components against union-find."""

import random
import re

import pytest

from loomery.llm import minhash_dedup
from loomery.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_sets(texts, k):
    out = []
    for t in texts:
        words = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    return out


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(texts, k, percent=80):
    sets = shingle_sets(texts, k)
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(parent, i), find(parent, i) == i) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(5)) for _ in range(400)]
    out = [None, "", " \n", "one two", "ONE Two", "one two three", "É one two three", "é one two three"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t "]).join(copy))
    out += [out[9], out[9].upper()]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 2)])
def test_matches_brute_force(make_docs, seed, block):
    texts = corpus(seed)
    got = [tuple(r) for r in minhash_dedup.component_digest(make_docs(texts), block=block).orderBy("doc_id").collect()]
    assert got == brute(texts, 4)


def test_chain_across_one_key(make_docs, monkeypatch):
    """A pivot that is like none of the others does not hide their links."""
    monkeypatch.setattr(minhash_dedup, "PART_ROWS", 3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[: 100 - 4 * i]) for i in range(20)]
    got = [tuple(r) for r in minhash_dedup.component_digest(make_docs(texts), block=2).orderBy("doc_id").collect()]
    assert got == brute(texts, 4)


def test_five_word_default_and_odd_rows(spark, make_docs):
    assert minhash_dedup.component_digest(make_docs([])).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (7, None, 4), (8, "", 5), (9, text + " x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.component_digest(docs).collect()}
    assert got == {(None, 5, False), (5, 5, True), (7, 7, True), (8, 8, True), (9, 5, False)}
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) in [[(5, text), (7, None), (8, "")]]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    parent = list(range(600))
    for u, v in edges:
        x, y = find(parent, u), find(parent, v)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(parent, x) for x in touched}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
