"""The whole pipeline on an empty table and on one with nulls, empty and long texts, repeated rows and clashing names."""

import random

import corpus_pipeline
from loomery.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    common.release(spark)
    return rows


def test_empty_table(spark, tmp_path):
    assert run(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)) == []


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 200))) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(None, None, None, None, None), (100, "", "en", "s1", 0), (None, clean[0] + " more", "en", None, 5), rows[3], rows[3], (101, "$$$ " * 100, "en", "s0", 400), (102, " ".join(rng.choice(words) for _ in range(60_000)), "en", "s2", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = good.collect()
    assert {r.doc_id for r in kept} >= set(range(30)) | {102} and not {100, 101} & {r.doc_id for r in kept} and not any(r.text in (None, "") for r in kept)
    near = stages["near_duplicates"](spark, spark.createDataFrame(kept, SCHEMA), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [*range(30), 102]  # repeated rows go, and the near copy without an id
    assert len([r for r in near if r.doc_id is None]) == 0
    assert len(run(spark, docs, str(tmp_path))) >= len(near)


def test_names_that_operators_use(spark, tmp_path):
    names = ["row", "__row", "__sum", "kept", "size", "shard", "copies"]
    rows = [(i, f"word{i} " + " ".join(f"w{(i * j) % 97}x{j}" for j in range(60)), "en", "s", 9, *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-len(names) :] == names, name
        for r in docs.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names), name
