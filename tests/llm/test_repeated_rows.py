"""Sharding and mixing where a large part of the rows repeat whole, with and without ids."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loomery.llm import common, mixing, sharding
from tests.llm.test_rules_and_batches import check_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(spark, hot_id, n=400):
    rows = [(hot_id, "hot text again " * 8, "x")] * n + [(i, f"text {i} " * (1 + i % 30), "y" if i % 4 else None) for i in range(2 * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


@pytest.mark.parametrize("hot_id", [5, None])
def test_shards_part_equal_rows(spark, hot_id, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 50)
    docs = repeated(spark, hot_id)
    rows = sharding.assign(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 8) for r in docs.collect())
    check_shards(rows, sharding.SHARDS, 2 * sharding.TOLERANCE)
    again = Counter((r.doc_id, r.shard, r.slot) for r in sharding.assign(docs.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.shard, r.slot) for r in rows)


def test_all_rows_equal(spark):
    docs = spark.createDataFrame([(1, "same")] * 240, "doc_id long, text string")
    rows = sharding.assign(docs).collect()
    assert Counter(r.shard for r in rows) == Counter(dict.fromkeys(range(24), 10))
    assert Counter(r.slot for r in rows) == Counter(dict.fromkeys(range(10), 24))


def test_written_shards_part_equal_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same text")] * 4000, "doc_id long, text string").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()
    assert sum(r["count"] for r in back) == 4000 and all(abs(r["count"] - 1000) < 200 for r in back)


@pytest.mark.parametrize("hot_id", [5, None])
def test_mix_takes_equal_rows_one_by_one(spark, hot_id, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 50)
    docs = repeated(spark, hot_id)
    rows = mixing.mix_digest(docs).collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted([tuple(r) for r in rows], key=str) == sorted(con.sql(mixing.ORACLE).fetchall(), key=str)
    taken, goal, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source_size] += r.taken
        goal[r.source_size] = r.target
        largest[r.source_size] = max(largest[r.source_size], r.size)
        assert 0 <= r.taken <= 2 * r.size
    assert len(goal) == 3 and all(goal[s] - largest[s] <= taken[s] <= goal[s] for s in goal)


def test_rows_equal_but_for_other_columns(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 50)
    docs = repeated(spark, 5).withColumn("lang", F.when(F.rand(3) < 0.3, "a").when(F.rand(4) < 0.5, "b"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = Counter()
    for r in mixing.mix_digest(docs).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in mixing.take(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert +got == +want
    assert Counter(map(tuple, mixing.take(docs).collect())) == Counter(map(tuple, mixing.take(docs.repartition(3)).collect()))
