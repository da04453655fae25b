"""Suffix-array and suffix-tree removal against brute force over every window."""

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from loomery.llm import repeats, substring_dedup, suffix_dedup
from loomery.llm.textkit import gram_hashes, range_hashes, sliding_argmin

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, window=20):
    seen, out = set(), []
    for t in texts:
        words = WORD.findall((t or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(15, 90)) for _ in range(6)]
    out = [None, "", "   \n\t", "one", "aaaa" * 200, "x" * 199, "x" * 200, "x" * 201, "ab " * 300]
    for _ in range(40):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 40))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    near = out[-1].split(" ")
    for i in range(8):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "edit"
        out.append(" ".join(copy))
    out += [out[12], out[12], out[13], out[13] + " tail"]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [out[i] for i in order]


def test_difference_cover():
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.V for a in cover for b in cover} == set(range(suffix_dedup.V))
    assert len(cover) < suffix_dedup.V / 3


def test_argmin_is_leftmost():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 5, 300, dtype=np.uint64) << np.uint64(40)
    for w in (1, 7, 100):
        got = sliding_argmin(keys, w)
        assert got.tolist() == [i + int(np.argmin(keys[i : i + w])) for i in range(300 - w + 1)]
    assert len(gram_hashes(keys, 301)) == 0 and len(sliding_argmin(keys, 301)) == 0


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"hot_classes": 1}), (3, {"block_bytes": 1 << 12})])
def test_bytes_match_brute_force(make_docs, seed, limits):
    texts = corpus(seed)
    rows = suffix_dedup.repeat_digest(make_docs(texts), **limits).orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in rows]
    assert got == brute_bytes(texts)
    assert [r.doc_id for r in rows] == list(range(len(texts)))


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"hot_classes": 1}), (3, {"block_bytes": 1 << 12})])
def test_words_match_brute_force(make_docs, seed, limits):
    texts = corpus(seed)
    got = [tuple(r)[1:] for r in substring_dedup.repeat_digest(make_docs(texts), **limits).orderBy("doc_id").collect()]
    assert got == brute_words(texts)


def test_subtrees_do_not_depend_on_their_limit():
    rng = np.random.default_rng(5)
    values = np.tile(rng.integers(0, 3, 400).astype(np.uint64), 3)
    n = np.array([300, 300, 300])
    block = repeats.Block(values, np.array([0, 400, 800]), np.zeros(3, int), np.zeros(3, int), n, np.array([2, 0, 1]))
    want = substring_dedup.suffix_tree_repeats(block, substring_dedup.UNITS)
    for limit in (1, 3, 50):
        assert (substring_dedup.suffix_tree_repeats(block, substring_dedup.UNITS, limit) == want).all()
    assert not want[300:600].all() and want[:300].all() and want[600:].all()


def test_long_text_in_parts(make_docs, monkeypatch):
    texts = ["".join(random.Random(i % 2).choices("abcd", k=3000)) + str(i) for i in range(4)]
    whole = repeats.neighbourhoods(*suffix_dedup.UNITS.read(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 3001])), suffix_dedup.UNITS)
    monkeypatch.setattr(repeats, "PART", 700)
    parts = repeats.neighbourhoods(*suffix_dedup.UNITS.read(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, 3001])), suffix_dedup.UNITS)
    assert sum(parts[2]) == sum(whole[2]) == 3001 - 199


def test_empty_and_odd_tables(spark, make_docs):
    assert suffix_dedup.repeat_digest(make_docs([])).count() == 0
    assert substring_dedup.repeat_digest(make_docs([])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (7, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long")
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.repeat_digest(docs).collect()}
    assert got == {(None, 60), (5, 0), (7, 0)}
    assert {r.n_removed for r in suffix_dedup.repeat_digest(docs).collect()} == {len(text), 0}
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.h: r.text for r in cut.collect()} == {1: "", 2: "", 3: "", 4: None}


def test_cut_keeps_whole_characters(make_docs):
    shared = "é" * 150
    got = [r.text for r in suffix_dedup.cut_repeats(make_docs(["aé" + shared + "b", "cè" + shared + "d"])).orderBy("doc_id").collect()]
    assert got == ["ab", "cèd"] or all("é" * 10 not in t for t in got)


def test_polynomial_collisions_do_not_count():
    """Thue-Morse strings have equal polynomial hashes modulo 2**64 under every base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = np.array(bits, np.uint64), 1 - np.array(bits, np.uint64)
    both = np.concatenate((a, b))
    assert range_hashes(both, np.array([0, 1024]), np.array([1024, 2048]))[0] != range_hashes(both, np.array([0, 1024]), np.array([1024, 2048]))[1]
    assert gram_hashes(a, 1024)[0] != gram_hashes(b, 1024)[0]
    values = np.random.default_rng(2).integers(0, 3, 50).astype(np.uint64)
    lo, hi = (x.ravel() for x in np.meshgrid(np.arange(51), np.arange(51)))
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    names = {}
    for x, y, h in zip(lo, hi, range_hashes(values, lo, hi)):
        assert names.setdefault(values[x:y].tobytes(), h) == h
    assert len(set(names.values())) == len(names)


HOT = """
import resource, sys
import numpy as np, pyarrow as pa
from loomery.llm import repeats, suffix_dedup
n = 200_000
rng = np.random.default_rng(1)
schema = pa.schema([("h", pa.int64()), ("sub", pa.int32()), ("w", pa.int64()), ("fp", pa.int64()), ("dk", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("off", pa.int32()), ("n", pa.int32()), ("content", pa.binary())])
def batches():
    for i in range(0, n, 5000):
        names = [(i + j) // 2 * 2 if (i + j) < n // 2 else 10**9 for j in range(5000)]  # pairs, then one window 100,000 times
        content = [np.random.default_rng(x).integers(0, 256, 200, dtype=np.uint8).tobytes() for x in names]
        one = np.ones(5000, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(5000, 7)), pa.array(one), pa.array(np.array(names)), pa.array(np.arange(i, i + 5000)), pa.array(np.arange(i, i + 5000)), pa.array(np.zeros(5000, np.int64)), pa.array(one * 0), pa.array(one * 0), pa.array(one), pa.array(content, pa.binary())], schema=schema)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
hits = set()
for out in repeats._solve(suffix_dedup.UNITS, suffix_dedup.suffix_array_repeats, repeats.BLOCK_BYTES)(batches()):
    hits |= set(out.column("fp").to_pylist())
print(len(hits), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_hot_anchor_takes_bounded_memory():
    """200,000 windows of one anchor, half of them one window: all are found repeated, in the memory of a block."""
    out = subprocess.run([sys.executable, "-c", HOT], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    found, mb = map(int, out.stdout.split())
    assert found == 200_000 and mb < 500
