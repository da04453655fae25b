"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of `documents`. Each stage's rows are written to the shared folder before the next
one reads them, so a lost executor never costs more than one stage's tasks; then what it read, and what
it wrote on the way, is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import minhash_dedup, mixing, packing, quality, suffix_dedup
from loomery.llm.common import discard, settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return minhash_dedup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that start in two places go from the texts; n_chars follows."""
    cut = suffix_dedup.cut_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every sequence with its length bucket, batch and place."""
    return packing.pack_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("batches", batches),
]
#: Stages 2, 3 and 5 can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda f=stage, d=docs: f(spark, d, sf_dir))
        if before:
            discard(spark, before)  # the stage after it has been written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
