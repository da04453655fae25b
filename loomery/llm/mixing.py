"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash; a source takes the documents below a threshold, so mixes are nested and
reruns agree. Sizes are summed by source and by the first bits of the hash; the bucket in which the
running sum passes the target is refined by the next bits, and only its documents are looked at
again. Two refinements settle the first BITS * LEVELS bits. Nothing is sorted but the sums, of which
a source has at most 2**BITS a level, and everything is DataFrame functions.

A target above a source's size takes every document once and a threshold of them twice. Nulls and
empty texts have size 0 and take 0; a null source is a source of its own, last in the order. Of rows
equal in doc_id, text and source each copy has its number in its hash, so they are taken one by one; a
row stands for its copies until then. Other columns are kept by `take`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, gapless, materialise, spread, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BITS = 12
LEVELS = 3


def _name(text):
    """The md5 of doc_id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))


def _hash(name, copy):
    """BITS * LEVELS bits of a copy's md5; the first copy has the document's own."""
    told = F.when(copy == 0, name).otherwise(F.md5(F.concat_ws(":", name, copy.cast("string"))))
    return F.shiftright(F.conv(F.substring(told, 1, 12), 16, 10).cast("long"), 48 - BITS * LEVELS)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source: shares of the total by weight, no more than `most` times its size.

    What is above a limit goes to the other sources by weight until none is above. In order of
    limit / weight the limited sources come first, so one pass of running sums finds them. `sizes` has
    a row per source.
    """
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    limit = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumns({"__limit": limit, "__total": F.sum("source_size").over(everything) * F.lit(float(share)), "__all_w": F.sum("__w").over(everything)})
    by_limit = Window.orderBy(F.col("__limit") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__total") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    weight_left = F.col("__all_w") - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("__rate", left / weight_left).withColumn("__turn", F.row_number().over(by_limit))
    free = F.col("__rate") * F.col("__w") <= F.col("__limit")
    rate = F.min(F.when(free, F.struct(F.col("__turn").alias("a"), F.col("__rate").alias("r")))).over(everything)["r"]
    return ranked.withColumn("target", F.least(F.coalesce(rate * F.col("__w"), F.col("__limit")), F.col("__limit"))).select("__source", "source_size", "target")


def _thresholds(hashed: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each source the first hash that is not taken once more: its sums up to there stay in the goal."""
    bits = BITS * LEVELS
    state = goals.select("__source", F.greatest(F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"), F.lit(0.0)).alias("__rest"), F.lit(0).cast("long").alias("__low"))
    running = Window.partitionBy("__source").orderBy("__cell")
    for level in range(1, LEVELS + 1):
        shift = bits - BITS * level
        same = F.col("h.__source").eqNullSafe(F.col("s.__source"))
        # documents in the source's boundary bucket so far
        inside = same & (F.shiftright("h.__hash", shift + BITS) == F.shiftright("s.__low", shift + BITS)) if level > 1 else same
        cells = hashed.alias("h").join(state.alias("s"), inside).groupBy("h.__source", "s.__rest", "s.__low", F.shiftright("h.__hash", shift).alias("__cell")).agg(F.sum("h.size").alias("__sum"))
        summed = cells.withColumn("__upto", F.sum("__sum").over(running))
        fits = F.col("__upto") <= F.col("__rest")
        found = summed.groupBy("__source", "__rest", "__low").agg(F.max(F.when(fits, F.col("__upto"))).alias("__took"), F.min(F.when(~fits, F.col("__cell"))).alias("__next"))
        # the rest is below the bucket's sum, so there always is a next boundary bucket
        state = found.select("__source", (F.col("__rest") - F.coalesce("__took", F.lit(0))).alias("__rest"), F.shiftleft("__next", shift).alias("__low"))
    return state.select("__source", F.col("__low").alias("__threshold"))


def sized(docs: DataFrame, row: list[str]) -> DataFrame:
    """`row` columns of docs with __source, __hash and size (words of the text), a row for every copy."""
    text = text_or_empty()
    named = docs.select(*row, F.col("source").cast("string").alias("__source"), _name(text).alias("__name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    if set(row) <= {"doc_id"}:  # nothing else tells copies apart
        counted = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("__copies"))
        every = spread(counted, "__copies", "__copy", ["__name", "__source"])
    else:  # texts are moved only where they repeat
        key = ["__name", "__source"]
        again, _ = materialise(named.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*key))
        same = (F.col("n.__name") == F.col("a.__name")) & F.col("n.__source").eqNullSafe(F.col("a.__source"))
        n, a = named.alias("n"), again.alias("a")
        once = n.join(a, same, "left_anti").withColumn("__copy", F.lit(0).cast("long"))
        counted = n.join(a, same, "left_semi").groupBy(*named.columns).agg(F.count(F.lit(1)).alias("__copies"))
        counted = counted.withColumn("__json", F.md5(F.to_json(F.struct(*row))))
        counted = gapless(counted, key, ["__json"], [F.substring("__json", 1, 2)], "__first", "__copies")
        every = spread(counted, "__copies", "__copy", key).withColumn("__copy", F.col("__first") + F.col("__copy")).drop("__json", "__first")
        every = once.unionByName(every)
    return every.withColumn("__hash", _hash(F.col("__name"), F.col("__copy"))).drop("__name", "__copy")


def mix(docs: DataFrame, keep: list[str], narrow: bool = False) -> DataFrame:
    """`keep` columns of docs with size, source_size, target, __copies (times taken) and taken (words).

    Narrow columns are written beside the sizes, so the texts are read once; wide ones are read again.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = sized(docs, keep).select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], "__source", "__hash", "size")
    measured, _ = materialise(rows if narrow else rows.select("__source", "__hash", "size"))
    rows = measured if narrow else rows
    hashed = measured.where("size > 0")
    goals, _ = materialise(targets(measured.groupBy("__source").agg(F.sum("size").alias("source_size"))))
    plan = goals.alias("g").join(_thresholds(hashed, goals.where("source_size > 0")).alias("t"), F.col("g.__source").eqNullSafe(F.col("t.__source")), "left").select("g.*", "t.__threshold")
    plan = plan.withColumn("__times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan, _ = materialise(plan)
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.__source").eqNullSafe(F.col("p.__source")))
    copies = F.col("__times") + F.coalesce((F.col("__hash") < F.col("__threshold")).cast("long"), F.lit(0))
    joined = joined.select(*[F.col(n) for n in names], "size", "source_size", "target", copies.alias("__copies"))
    return joined.withColumn("taken", F.col("size") * F.col("__copies")).select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "size", "source_size", "target", "__copies", "taken")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(docs.select("doc_id", "text", "source"), ["doc_id"], narrow=True).drop("__copies")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    wrapped = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))
    mixed = mix(wrapped, ["__row"])
    return mixed.where("__copies > 0").select(F.explode(F.array_repeat("__row", F.col("__copies").cast("int"))).alias("r")).select("r.*")


ORACLE = r"""
WITH named AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS name,
         row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1 AS copy
  FROM documents),
docs AS (
  SELECT doc_id, source, size, ('0x' || substr(CASE WHEN copy = 0 THEN name ELSE md5(name || ':' || copy) END, 1, 12))::BIGINT >> 12 AS h
  FROM named),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM sources),
rates AS (
  SELECT *, (total - coalesce(sum(lim) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS rate,
         row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS turn FROM ranked
  WINDOW b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT *, (SELECT arg_min(rate, turn) FROM rates WHERE rate * w <= lim) AS r FROM rates),
goals AS (
  SELECT source, source_size, least(coalesce(r * w, lim), lim) AS target FROM chosen),
running AS (
  SELECT d.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS times,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN upto <= target - times * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
