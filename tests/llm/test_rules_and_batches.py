"""Quality rules, sharding, packing, mixing and the pipeline against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import mixing, packing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé#") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    out = [None, "", " \n ", "a b", "x " * 30, "line one here\n" * 12, "word"]
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(parts))
        out.append(rng.choice(["\n", " ", " \n"]).join(parts))
    return out


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def again(k):
        seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return [i for i in range(n - k + 1) if seen[tuple(words[i : i + k])] > 1]

    def cover(k):
        return len({j for i in again(k) for j in range(i, i + k)})

    longest = 0
    while again(k := max(longest + 1, quality.MIN_REPEAT)):  # a repeat of k words holds one of k - 1
        longest = k
    failed = n < 20 or 100 * cover(8) > 30 * n
    covered = cover(quality.MIN_REPEAT)
    kept = not failed and covered <= quality.MAX_COVERED * n and longest <= quality.MAX_LONGEST * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), cover(8), covered, longest, failed, kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_matches_brute_force(make_docs, seed):
    made = texts(seed)
    got = [tuple(r)[1:] for r in quality.quality_digest(make_docs(made)).orderBy("doc_id").collect()]
    assert got == [brute_quality(t) for t in made]
    assert {g[-1] for g in got} == {True, False}


def test_quality_keeps_columns(spark, make_docs):
    docs = make_docs(texts(3)).withColumn("quality", F.lit(1)).withColumn("kept", F.lit("x"))
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_digest(make_docs([])).count() == 0


def check_shards(rows, shards, slack):
    sizes = Counter()
    slots = defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    largest = max(r.size for r in rows)
    assert all(abs(sizes[s] - mean) <= slack * mean + largest for s in range(shards)), sizes


def test_shards_are_near_equal(spark, sf, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count()
    check_shards(rows, sharding.SHARDS, 2 * sharding.TOLERANCE)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == crc32(text[r.doc_id].encode()) for r in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_hot_text_is_cut_and_small_groups_are_not(make_docs):
    docs = make_docs(["hot " * 50] * 400 + [f"text {i // 2} " * 20 for i in range(1600)])
    rows = sharding.assign(docs, shards=8, tolerance=0.02).collect()
    check_shards(rows, 8, 0.04)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 1


def test_odd_shards(spark, make_docs):
    assert sharding.assign(make_docs([])).count() == 0
    rows = sharding.assign(spark.createDataFrame([(None, None), (None, None), (3, "é")], "doc_id long, text string")).collect()
    assert sorted(r.size for r in rows) == [8, 8, 10] and all(r.grown_shard is None and r.law == "bytes" for r in rows)


def test_written_shards_hold_every_row(make_docs, spark, tmp_path):
    docs = make_docs([f"text {i} " * (i % 9) for i in range(200)])
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 200


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.sort(rng.choice(60, rng.integers(1, 9), replace=False)) + 1
        counts = rng.integers(1, 50, len(lengths))
        for k in (1, 2, 3, 5):
            best = min(
                sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts))
                for size in range(1, k + 1)
                for rest in itertools.combinations(lengths[:-1], min(size - 1, len(lengths) - 1))
                for tops in [(*rest, lengths[-1])]
            )
            tops, padding = packing.boundaries(lengths, counts, k)
            assert padding == best and len(tops) <= k and tops[-1] == lengths[-1]
            assert sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts)) == best


def test_packing_keeps_all_and_fills_batches(make_docs):
    made = texts(5, 150) + ["w " * 5000]
    rows = packing.pack(make_docs(made), ["doc_id"], longest=100, budget=700, buckets=4).collect()
    total = Counter()
    batches = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.length
        assert r.length <= r.padded <= 100 and (r.bucket == 0) == (r.length == 0) == (r.batch is None)
        if r.batch is not None:
            batches[r.bucket, r.batch].append(r)
    assert [total[i] for i in range(len(made))] == [len(WORD.findall(t or "")) for t in made]
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (b, k), held in batches.items():
        each = max(1, 700 // held[0].padded)
        assert sorted(r.place for r in held) == list(range(len(held)))
        assert len(held) == each or k == last[b]
    assert packing.pack_digest(make_docs([])).count() == 0


def mix_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(con.sql(mixing.ORACLE).fetchall(), key=str)


def test_mix_matches_sql_and_targets(spark, make_docs):
    made = texts(7, 400)
    docs = make_docs(made).withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 50 == 1, "tiny").otherwise("mid"))
    rows = mixing.mix_digest(docs).collect()
    assert sorted([tuple(r) for r in rows], key=str) == mix_sql(docs)
    taken, target = Counter(), {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = (r.target, r.source_size)
    largest = max(r.size for r in rows)
    for s, (goal, size) in target.items():
        assert goal <= 2 * size + 1e-6 and goal - largest <= taken[s] <= goal
    kept = mixing.take(docs)
    assert kept.columns == docs.columns and sum(len(WORD.findall(r.text or "")) for r in kept.collect()) == sum(taken.values())


def test_odd_mixes(spark, make_docs):
    assert mixing.mix_digest(make_docs([])).count() == 0
    rows = mixing.mix_digest(make_docs([None, "", " "])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 3


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from tests.llm.test_minhash import brute as brute_near
    from tests.llm.test_repeats import brute_bytes

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(cp.STAGES)
    good = stage["quality_rules"](spark, docs, sf).orderBy("doc_id").collect()
    assert [r.doc_id for r in good] == [r.doc_id for r in docs.orderBy("doc_id").collect() if brute_quality(r.text)[-1]]
    frame = spark.createDataFrame(good, docs.schema)
    near = stage["near_duplicates"](spark, frame, sf).orderBy("doc_id").collect()
    assert [r.doc_id for r in near] == [good[i].doc_id for i, _, _, kept in brute_near([r.text for r in good], 5) if kept]
    cut = stage["repeated_passages"](spark, spark.createDataFrame(near, docs.schema), sf)
    assert cut.columns == docs.columns
    rows = cut.collect()
    cut = spark.createDataFrame(rows, docs.schema)
    removed = {r.doc_id: len(r.text.encode()) for r in rows}
    for r, (n, gone, _, _) in zip(near, brute_bytes([r.text for r in near])):
        assert n - gone <= removed[r.doc_id] <= n - gone + 6
    mixed = stage["source_mix"](spark, cut, sf)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    packed = cp.run(spark, sf)
    assert packed.agg(F.sum("length")).first()[0] == words
    assert [s for s, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "batches"]


def test_lines_that_polynomials_take_for_equal(make_docs):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    lines = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    row = quality.quality_digest(make_docs(["\n".join(lines), "\n".join([lines[0], *lines])])).orderBy("doc_id").collect()
    assert [r.n_dup_lines for r in row] == [0, 1]


def test_clashing_names(spark, make_docs, tmp_path):
    """Columns called as the operators' own come back, with an underscore where both stand side by side."""
    from loomery.llm import minhash_dedup, suffix_dedup

    names = ["dk", "th", "row", "text_", "quality", "shard", "length", "piece", "kept", "size", "__s", "__dk", "hi", "lo", "label"]
    docs = make_docs([" ".join(f"w{j}" for j in range(i % 7, 60)) for i in range(20)]).withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    for f in (quality.keep_good, minhash_dedup.drop_near_duplicates, suffix_dedup.cut_repeats, mixing.take):
        got = f(docs)
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[n] == f"{n} {r.doc_id}" for n in names)
    packed = packing.pack(docs, ["doc_id", "length", "piece", "dk"])
    assert packed.columns == ["doc_id", "length_", "piece_", "dk", *packing.MADE] and all(r.length_ == f"length {r.doc_id}" and r.length > 0 for r in packed.collect())
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(back) == 20 and all(r.shard_ == f"shard {r.doc_id}" and 0 <= r.shard < 3 for r in back)


def test_near_duplicates_among_rows_of_one_id(spark):
    from loomery.llm import minhash_dedup

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, x) for x in ("b", "a", "c")] + [(2, text, "d"), (3, "", "e"), (3, "", "f"), (None, text + " end", "g")]
    got = [sorted(r.x for r in minhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(n)).collect()) for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3 and got[0][-2:] == ["e", "f"]


def test_shards_equal_a_plain_cut_by_bytes(make_docs):
    """Rows in order of their keys, cut where the bytes pass each share: every boundary within the tolerance of that cut."""
    docs = make_docs([f"text {i} " * (i % 40) for i in range(1500)])
    rows = sharding.keyed_sizes(docs).collect()
    ordered = sorted(rows, key=lambda r: (r.hi, r.lo))
    total = sum(r.size for r in rows)
    upto = np.cumsum([r.size for r in ordered])
    got = {r.doc_id: r.shard for r in sharding.assign(docs, shards=6, tolerance=0.02).collect()}
    shards = [got[r.doc_id] for r in ordered]
    assert shards == sorted(shards)
    for s in range(1, 6):
        cut = sum(x < s for x in shards)
        assert abs(upto[cut - 1] - total * s / 6) <= 0.02 * total / 6 + max(r.size for r in rows)


def test_whole_packing_against_a_plain_program(make_docs):
    made = texts(9, 120) + ["w " * 450]
    rows = packing.pack(make_docs(made), ["doc_id"], longest=200, budget=900, buckets=5).collect()
    lengths = []
    for i, t in enumerate(made):
        n = len(WORD.findall(t or ""))
        lengths += [(i, p, max(0, min(200, n - 200 * p))) for p in range(max(1, -(-n // 200)))]
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == sorted(lengths)
    histogram = Counter(n for _, _, n in lengths if n)
    values = sorted(histogram)
    best = {(-1, 0): (0, [])}
    for k in range(1, 6):  # plain dynamic programming over all boundaries
        for j in range(len(values)):
            options = [(best[i, k - 1][0] + sum(histogram[v] * (values[j] - v) for v in values[i + 1 : j + 1]), best[i, k - 1][1] + [values[j]]) for i in range(-1, j) if (i, k - 1) in best]
            if options:
                best[j, k] = min(options)
    padding = min(best[len(values) - 1, k][0] for k in range(1, 6) if (len(values) - 1, k) in best)
    assert sum(r.padded - r.length for r in rows) == padding
    for bucket in {r.bucket for r in rows if r.bucket}:
        held = [r for r in rows if r.bucket == bucket]
        each = max(1, 900 // held[0].padded)
        assert sorted((r.batch, r.place) for r in held) == [(k // each, k % each) for k in range(len(held))]


@pytest.mark.parametrize("seed", range(4))
def test_repeat_lengths_over_few_words(seed):
    """Small alphabets, where repeats run into each other and into the ends of texts: spans and longest by brute force."""
    from loomery.llm.textkit import buffers

    import pyarrow as pa

    rng = random.Random(seed)
    made = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    data, offsets = buffers(pa.array(made))
    got = [tuple(x.tolist()) for x in quality.measure(data, offsets)]
    assert list(zip(*got)) == [brute_quality(t) for t in made]
