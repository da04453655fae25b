"""Phrases of a dictionary in texts: words and stems of any length, combinations, context windows, triage.

A phrase is a run of words; a word that ends in `*` is a stem and stands for every word that begins with
it. Words of a text are its runs of letters and digits in lower case. A phrase is looked for by its anchor, the word
that fewest phrases hold (a stem by its first letters): the words of the texts meet the anchors by equality, so the
dictionary may be as large as the texts, and what is left is compared word by word in the text that
holds it. `triage` writes its dictionary and its hits as tables (`graph.release` deletes them): Spark then knows
the dictionary's size and broadcasts a small one, so only candidates are shuffled, and no plan repeats the search.

`keys` name a text: one row for each. Null and empty texts hold nothing; phrases without words are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

#: Letters of a stem that make its key; a shorter stem goes by all of its letters.
STEM_KEY = 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def dictionary(phrases: DataFrame, phrase: str, code: str) -> DataFrame:
    """(code, words, anchor, key): a row for each phrase and code; anchor is the place of its rarest word."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(phrase, r"[^\p{L}\p{N}*]+", " ")), " "), lambda w: F.length(F.replace(w, F.lit("*"), F.lit(""))) > 0)
    rows = phrases.select(F.col(code).alias("code"), parts.alias("words")).where(F.size("words") > 0).distinct()
    stem = F.col("word").endswith("*")
    key = F.when(stem, F.concat(F.lit("*"), F.substring(F.regexp_replace("word", r"\*+$", ""), 1, STEM_KEY))).otherwise(F.col("word"))
    each = rows.select("code", "words", F.posexplode("words").alias("at", "word")).withColumn("key", key)
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    # whole words before stems, then the one that fewest phrases hold
    order = F.struct(F.col("key").startswith("*"), "held", "at")
    return each.join(held, "key").groupBy("code", "words").agg(F.min_by(F.struct("at", "key"), order).alias("a")).select("code", "words", F.col("a.at").alias("anchor"), F.col("a.key").alias("key"))


def fits(word: Column, pattern: Column) -> Column:
    stem = F.regexp_replace(pattern, r"\*+$", "")
    return F.when(pattern.endswith("*"), word.startswith(stem)).otherwise(word == pattern)


def hits(texts: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """(keys, at, to, code): every place in words, from 0, where a phrase of a `dictionary` stands; overlaps too."""
    worded = texts.select(*keys, words_of(F.col(text)).alias("__w"))
    tokens = worded.select(*keys, F.posexplode("__w").alias("__at", "__word"))
    heads = [F.concat(F.lit("*"), F.substring("__word", 1, n)) for n in range(1, STEM_KEY + 1)]
    every = F.array_distinct(F.array(F.col("__word"), *heads))
    # a stem of n letters has a key of n letters, so of a token's heads few are keys at all
    met = tokens.withColumn("key", F.explode(every)).join(known, "key").select(*keys, (F.col("__at") - F.col("anchor")).alias("at"), "words", "code").where("at >= 0")
    listed = met.groupBy(*keys).agg(F.collect_set(F.struct("at", "words", "code")).alias("__c"))
    here = lambda c: F.slice(F.col("__w"), c["at"] + 1, F.size(c["words"]))
    whole = lambda c: (c["at"] + F.size(c["words"]) <= F.size("__w")) & F.forall(F.zip_with(here(c), c["words"], fits), lambda x: x)
    found = worded.join(listed, keys).select(*keys, F.explode(F.filter("__c", whole)).alias("c"))
    return found.select(*keys, "c.at", (F.col("c.at") + F.size("c.words")).alias("to"), "c.code").distinct()


def longest_mentions(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str, code: str) -> DataFrame:
    """(keys, at, to, code): longer phrases first, then earlier ones, none over another; of codes in one place the smallest."""
    found = hits(texts, keys, text, dictionary(phrases.select(phrase, F.col(code).cast("string").alias(code)), phrase, code)).groupBy(*keys, "at", "to").agg(F.min("code").alias("code"))
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("at") - F.col("to")).alias("size"), "at", "to", "code"))).alias("c"))
    kind = F.expr("cast(array() as array<struct<size:int,at:int,to:int,code:string>>)")
    free = lambda acc, x: ~F.exists(acc, lambda t: (x["at"] < t["to"]) & (t["at"] < x["to"]))
    taken = F.aggregate("c", kind, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select(*keys, F.explode(taken).alias("t")).select(*keys, "t.at", "t.to", "t.code")


def away_from(found: DataFrame, keys: list[str], context: DataFrame, before: int, after: int) -> DataFrame:
    """Hits with no hit of `context` within so many words before or after them."""
    near = context.select(*keys, F.col("at").alias("__a"), F.col("to").alias("__b")).distinct()
    close = found.join(near, keys).where((F.col("__b") > F.col("at") - before) & (F.col("__a") < F.col("to") + after)).select(*keys, "at", "to", "code").distinct()
    return found.join(close, [*keys, "at", "to", "code"], "left_anti")


def triage(texts: DataFrame, keys: list[str], text: str, rules: DataFrame, flags: DataFrame, context: DataFrame, before: int = 6, after: int = 5) -> DataFrame:
    """(keys, flag, labels, confidence, tied) of every text.

    rules: rule, phrase, weight, label, place. A rule's hits are the phrases of it that the text holds; each gives its
    weight to the label at place 0 and half of it to the others. labels are the three of the highest
    scores, ties by name. confidence is min(1, top / 3) * (0.5 + 0.5 * top / total), to three places; tied when two
    labels share the top. flags: flag, rank, combo, part, phrase, contextual. A flag is raised when of one of its
    combos every part holds a phrase; phrases marked contextual don't count near a phrase of `context` (phrase). Of
    several flags the one of the least rank is told.
    """
    name = F.concat_ws("\x01", F.lit("r"), "phrase")
    patterns = rules.select("phrase", name.alias("code")).union(flags.select("phrase", name.alias("code"))).union(context.select("phrase", F.lit("c").alias("code"))).distinct()
    found = kept(hits(texts, keys, text, kept(dictionary(patterns, "phrase", "code"))))
    spoken = found.where("code <> 'c'").withColumn("phrase", F.substring(F.col("code"), F.lit(3), F.length("code")))
    held = spoken.select(*keys, "phrase").distinct()
    score = held.join(rules.select("phrase", "weight", "label", "place"), "phrase").groupBy(*keys, "label").agg(F.sum(F.col("weight") * F.when(F.col("place") == 0, 1.0).otherwise(0.5)).alias("__score"))
    w = Window.partitionBy(*keys)
    ranked = score.withColumns({"__n": F.row_number().over(w.orderBy(F.desc("__score"), "label")), "__top": F.max("__score").over(w), "__total": F.sum("__score").over(w)})
    first = F.array_sort(F.collect_list(F.when(F.col("__n") <= 3, F.struct("__n", "label"))))
    best = ranked.groupBy(*keys).agg(first.alias("__l"), F.max("__top").alias("__top"), F.max("__total").alias("__total"), (F.count_if(F.col("__score") == F.col("__top")) > 1).alias("tied"))
    confidence = F.floor(F.least(F.lit(1.0), F.col("__top") / 3) * (0.5 + 0.5 * F.col("__top") / F.col("__total")) * 1000 + 0.5) / 1000
    best = best.select(*keys, F.transform("__l", lambda x: x["label"]).alias("labels"), confidence.alias("confidence"), "tied")
    far = away_from(found.where("code <> 'c'"), keys, found.where("code = 'c'"), before, after).withColumn("phrase", F.substring(F.col("code"), F.lit(3), F.length("code"))).select(*keys, "phrase", F.lit(True).alias("far")).distinct()
    said = held.join(far, [*keys, "phrase"], "left").join(flags, "phrase").where(~F.col("contextual") | F.col("far"))
    parts = flags.groupBy("flag", "rank", "combo").agg(F.count_distinct("part").alias("parts"))
    full = said.groupBy(*keys, "flag", "combo").agg(F.count_distinct("part").alias("parts")).join(parts, ["flag", "combo", "parts"])
    raised = full.groupBy(*keys).agg(F.min(F.struct("rank", "flag"))["flag"].alias("flag"))
    out = texts.select(*keys).join(raised, keys, "left").join(best, keys, "left")
    none = F.array().cast("array<string>")
    return out.select(*keys, "flag", F.coalesce("labels", none).alias("labels"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("tied", F.lit(False)).alias("tied"))
