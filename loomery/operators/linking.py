"""Linking mentions to names: n-gram keys, blocked edit distance, a cascade of ever looser lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_repeats, damerau_within, jaccard, one_edit, osa_distance, osa_within, trigrams, unfold_leet, words_only
from .graph import kept


def ngram_index(names: DataFrame, key: str, text: str, sizes=(1, 2, 3), most_owners: int = 8) -> DataFrame:
    """(gram, key): word n-grams of the names; grams of many owners say too little and are left out."""
    words = F.filter(F.split(F.col(text), " "), lambda x: x != "")
    at = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    grams = names.select(key, F.explode(F.array_distinct(F.concat(*[at(n) for n in sizes]))).alias("gram"))
    few = grams.groupBy("gram").agg(F.count_distinct(key).alias("owners")).where(F.col("owners") <= most_owners)
    return grams.join(few.select("gram"), "gram", "left_semi")


def blocked_distance(left: DataFrame, right: DataFrame, a: str, b: str, most: int, block: int = 1, exact_swaps: bool = False) -> DataFrame:
    """Pairs of equal first `block` characters and at most `most` edits apart.

    Lengths differ by no more than `most`, so the join is on (head, length) and not on the head alone.
    """
    l = left.withColumns({"__h": F.substring(a, 1, block), "__n": F.explode(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.length(a) + d))})  # noqa: E741
    r = right.withColumns({"__h": F.substring(b, 1, block), "__n": F.length(b)})
    pairs = l.join(r, ["__h", "__n"]).drop("__h", "__n")
    distance = osa_distance(F.col(a), F.col(b)) if exact_swaps else F.levenshtein(F.col(a), F.col(b))
    return pairs.withColumn("distance", distance).where((F.col("distance") >= 0) & (F.col("distance") <= most))


def one_edit_pairs(words: DataFrame, word: str, block: int = 1, exact_swaps: bool = False) -> DataFrame:
    """(a, b, distance): pairs a < b of words with equal first `block` characters that are one edit apart.

    The words of such a pair, or what is left of them without some one character, are equal, so the join
    is on these remains.
    """
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word))))
    every = words.select(word).where(F.length(word) > 0).distinct()
    keyed = every.select(F.col(word).alias("a"), F.substring(word, 1, block).alias("__h"), F.explode(F.array_distinct(F.concat(F.array(word), less))).alias("__k"))
    pairs = keyed.join(keyed.withColumnRenamed("a", "b"), ["__h", "__k"]).where("a < b").select("a", "b").distinct()
    # the words differ, so at most one edit is one
    distance = F.when(one_edit(F.col("a"), F.col("b")), 1) if exact_swaps else F.levenshtein(F.col("a"), F.col("b"))
    return pairs.withColumn("distance", distance.cast("int")).where("distance <= 1")


def similar_by_trigrams(names: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(a, b, similarity) of names whose trigram sets overlap by `least` or more.

    Two such sets share one of their rarest trigrams: of n, the n - ceil(least * n) + 1 that fewest names
    hold. Pairs come from those alone, so a frequent trigram pairs nothing off.
    """
    sets = names.select(key, trigrams(F.col(text)).alias("__t"))
    grams = sets.select(key, F.size("__t").alias("__n"), F.explode("__t").alias("__g"))
    held = grams.groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy("__c", "__g"))
    rare = grams.join(held, "__g").withColumn("__r", turn).where(F.col("__r") <= F.col("__n") - F.ceil(F.col("__n") * F.lit(least)) + 1).select(key, "__g")
    pairs = rare.join(rare.withColumnRenamed(key, "b"), "__g").where(F.col(key) < F.col("b")).select(F.col(key).alias("a"), "b").distinct()
    full = pairs.join(sets.select(F.col(key).alias("a"), F.col("__t").alias("__ta")), "a").join(sets.select(F.col(key).alias("b"), F.col("__t").alias("__tb")), "b")
    shared = F.size(F.array_intersect("__ta", "__tb"))
    similarity = shared / (F.size("__ta") + F.size("__tb") - shared)
    return full.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def cascade(mentions: DataFrame, mention: str, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first stage that knows a mention decides: (mention, key, stage). A stage has (mention, key)."""
    found = [rows.select(mention, "key", F.lit(i).alias("__i"), F.lit(name).alias("stage")) for i, (name, rows) in enumerate(stages)]
    first = Window.partitionBy(mention).orderBy("__i", "key")
    best = reduce(DataFrame.unionByName, found).withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return mentions.join(best.select(mention, "key", "stage"), mention, "left")


def blended(a: Column, b: Column) -> Column:
    """Half trigram overlap, half edit similarity."""
    edits = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (jaccard(trigrams(a), trigrams(b)) + edits) / 2


#: Of two names' similarity: an edit score as high as this stands alone, and no more edits than this count. Fixed values.
SURE_EDITS, FAR_EDITS = 0.82, 3
#: Names no longer than this meet by what is left of them without their edits, longer ones by their rarest trigrams.
SHORT_NAME = 4 * FAR_EDITS


def name_similarity(a: Column, b: Column) -> Column:
    """0 to 1: by edits (a swap is one, also of letters that something then parts) 1 - edits / longer length, unless that is under SURE_EDITS and the trigram overlap is more.

    Edits count up to a third of the longer length plus one, and up to FAR_EDITS. Empty names are like none.
    """
    longer = F.greatest(F.length(a), F.length(b))
    allowed = F.least(F.lit(FAR_EDITS), F.floor(longer / 3).cast("int") + 1)
    distance = damerau_within(a, b, allowed)
    edits = F.when(distance <= allowed, 1 - distance / longer).otherwise(0.0)
    both = F.when(edits >= SURE_EDITS, edits).otherwise(F.greatest(jaccard(trigrams(a), trigrams(b)), edits))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(both)


def _numbered_trigrams(text: Column) -> Column:
    """All trigrams of the padded text, each with the number of its like so far: as many as the text has characters."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    return F.transform(every, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(every, F.lit(1), i), lambda o: o == g)).alias("k")))


def similar_names(names: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, similarity), a before b: all pairs of distinct names whose name_similarity is `least` or more.

    Pairs come from equalities only and none is lost. Those alike by trigrams share one of their rarest, as in
    similar_by_trigrams. Those alike by edits have at most FAR_EDITS, which leave in common what remains of either without as many
    characters; names are asked for that up to SHORT_NAME characters. Every edit changes at most four trigrams, so if one of the two is longer
    they share one of the 4 * FAR_EDITS + 1 rarest of each. Null and empty names are like none; `least` is above 0.
    """
    known = kept(names.select(F.col(name).alias("a")).where("a <> ''").distinct())
    by_grams = similar_by_trigrams(known, "a", "a", least).select("a", "b")
    most = F.least(F.lit(FAR_EDITS), F.floor((F.length("a") + FAR_EDITS) * F.lit(1 - least) + 1e-9).cast("int"))
    keyed = lambda df, k: df.select("a", F.explode(k).alias("k"))
    met = lambda df: df.join(df.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b")
    short = met(keyed(known.where(F.length("a") <= SHORT_NAME), remains(F.col("a"), most)))
    grams = kept(keyed(known, _numbered_trigrams(F.col("a"))))
    held = kept(grams.groupBy("k").agg(F.count(F.lit(1)).alias("c")))
    turn = F.row_number().over(Window.partitionBy("a").orderBy("c", "k"))
    rarest = grams.join(held, "k").withColumn("r", turn).where(F.col("r") <= 4 * FAR_EDITS + 1).select("a", "k")
    # such a gram may be frequent where names are much alike, so lengths are compared at once
    long = met(rarest).where((F.abs(F.length("a") - F.length("b")) <= FAR_EDITS) & (F.greatest(F.length("a"), F.length("b")) > SHORT_NAME))
    pairs = kept(by_grams.unionByName(short).unionByName(long).distinct())
    return pairs.withColumn("similarity", name_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)


def phrase_score(query: Column, name: Column) -> Column:
    """0 equal, 1 begins with, 2 a word begins with, 3 contains, null no match; lower is better."""
    q, n = F.lower(F.trim(query)), F.lower(name)
    return F.when(n == q, 0).when(n.startswith(q), 1).when(F.contains(F.concat(F.lit(" "), n), F.concat(F.lit(" "), q)), 2).when(F.contains(n, q), 3)


def classify(tokens: DataFrame, keys: list[str], rules: DataFrame, position: str = "place") -> DataFrame:
    """Scores of labels by word rules: weight x hits, later mentions at half weight; the best one, its share and ties.

    tokens: keys, word, place (from 0). rules: word, label, weight.
    """
    factor = F.when(F.col(position) == 0, 1.0).otherwise(0.5)
    scored = tokens.join(rules, "word").groupBy(*keys, "label").agg(F.sum(F.col("weight") * factor).alias("score"))
    w = Window.partitionBy(*keys)
    ranked = scored.withColumns({"total": F.sum("score").over(w), "__r": F.row_number().over(w.orderBy(F.desc("score"), "label")), "__top": F.max("score").over(w)})
    tied = F.sum((F.col("score") == F.col("__top")).cast("int")).over(w) > 1
    return ranked.withColumn("tied", tied).where("__r = 1").select(*keys, "label", "score", (F.col("score") * (0.5 + 0.5 * F.col("score") / F.col("total"))).alias("strength"), "tied")


def catalog_search(items: DataFrame, key: str, phrases: str, query: str, order: str) -> DataFrame:
    """Items by the best of their phrases' ranks for a query, then in catalog order; an empty query finds all."""
    from ..functions.text import phrase_rank, words_only

    asked = words_only(F.lit(query))
    best = F.array_min(F.filter(F.transform(phrases, lambda p: phrase_rank(words_only(p), asked)), lambda r: r.isNotNull()))
    rows = items.withColumn("score", F.when(asked == "", F.lit(0)).otherwise(best)).where("score IS NOT NULL")
    return rows.select(key, "score", order)


def _without_one(word: Column) -> Column:
    """The word without each one of its characters."""
    at = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def remains(word: Column, edits: Column) -> Column:
    """The word and what is left of it without one, any two, or any three, of its characters.

    Two words that `edits` insertions, removals, replacements and swaps of neighbours part have one of these in common.
    """
    one = _without_one(word)
    two = F.flatten(F.transform(one, _without_one))
    three = F.flatten(F.transform(F.array_distinct(two), _without_one))
    return F.array_distinct(F.when(edits >= 3, F.concat(F.array(word), one, two, three)).when(edits == 2, F.concat(F.array(word), one, two)).when(edits == 1, F.concat(F.array(word), one)).otherwise(F.array(word)))


def edits_allowed(word: Column) -> Column:
    """Words of 5 letters may have 1 edit, of 10 letters 2."""
    return F.when(F.length(word) >= 10, 2).when(F.length(word) >= 5, 1).otherwise(0)


def fuzzy_names(mentions: DataFrame, names: DataFrame, mention: str, name: str) -> DataFrame:
    """(mention, name, distance): the nearest name within the edits that the mention's length allows, wherever they fall; a swap is one edit.

    The join is on what is left of either without the edited characters, so no pair is lost to a block and only
    alike words are compared.
    """
    m = mentions.select(mention).where(F.col(mention).isNotNull()).distinct().withColumn("__allowed", edits_allowed(F.col(mention)))
    m = m.withColumn("__k", F.explode(remains(F.col(mention), F.col("__allowed"))))
    # a name that two edits reach has 8 letters at least, one that one edit reaches has 4
    reach = F.when(F.length(name) >= 8, 2).when(F.length(name) >= 4, 1).otherwise(0)
    n = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("__k", F.explode(remains(F.col(name), reach)))
    pairs = m.join(n, "__k").select(mention, name, "__allowed").distinct()
    near = pairs.withColumn("distance", osa_within(F.col(mention), F.col(name), F.col("__allowed"))).where(F.col("distance") <= F.col("__allowed"))
    return near.groupBy(mention).agg(F.min(F.struct("distance", name)).alias("b")).select(mention, f"b.{name}", "b.distance")


#: Stages of `resolve` in order.
STAGES = ("exact", "folded", "fuzzy")
SIMILAR = 0.86
MOST_EDITS = 2


def resolve(mentions: DataFrame, names: DataFrame, text: str, place: str, mention: str, name: str, budget: int = 8) -> DataFrame:
    """(text, place, mention, name, stage): each mention by the first stage that knows it.

    exact: equal words. folded: equal once signs that stand for letters are letters and repeated ones are one. fuzzy: the
    most similar name, 1 - edits / longer length being SIMILAR or more and the edits MOST_EDITS at most (ties by name).
    A stage sees only what the one before left over, and of each text the first `budget` leftovers in order of
    place reach the fuzzy one; the others are over_budget. What no stage knows is unknown, with a null name.
    Of several names that look the same in a stage the smallest counts. text and place name a mention.
    """
    exact = lambda c: words_only(F.col(c))
    folded = lambda c: collapse_repeats(unfold_leet(words_only(F.col(c))))
    left = kept(mentions.select(text, place, mention))
    known = kept(names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct())
    done = []
    for stage, key in (("exact", exact), ("folded", folded)):
        table = known.groupBy(key("name").alias("__k")).agg(F.min("name").alias("name")).where("__k <> ''")
        met = kept(left.withColumn("__k", key(mention)).join(table, "__k", "left").drop("__k"))
        done.append(met.where("name IS NOT NULL").withColumn("stage", F.lit(stage)))
        left = met.where("name IS NULL").drop("name")
    turn = F.row_number().over(Window.partitionBy(text).orderBy(place))
    left = kept(left.withColumn("__turn", turn))
    over = left.where(F.col("__turn") > budget).drop("__turn").withColumns({"name": F.lit(None).cast("string"), "stage": F.lit("over_budget")})
    tried = left.where(F.col("__turn") <= budget).drop("__turn")
    said = tried.select(mention).distinct().withColumn("__a", words_only(F.col(mention)))
    spelt = known.withColumn("__b", words_only(F.col("name")))
    reach = lambda c: F.least(F.floor((F.length(c) + MOST_EDITS) * F.lit(1 - SIMILAR) + 1e-9), F.lit(MOST_EDITS))
    keyed = lambda df, c: df.withColumn("__k", F.explode(remains(F.col(c), reach(c))))
    pairs = keyed(said, "__a").join(keyed(spelt, "__b"), "__k").select(mention, "__a", "name", "__b").distinct()
    pairs = pairs.withColumn("__d", osa_within("__a", "__b", F.lit(MOST_EDITS))).where(F.col("__d") <= MOST_EDITS)
    alike = pairs.withColumn("__s", 1 - F.col("__d") / F.greatest(F.length("__a"), F.length("__b"))).where(F.col("__s") >= SIMILAR)
    best = alike.groupBy(mention).agg(F.min_by("name", F.struct(-F.col("__s"), "name")).alias("name"))
    last = tried.join(best, mention, "left").withColumn("stage", F.when(F.col("name").isNotNull(), "fuzzy").otherwise("unknown"))
    columns = [text, place, mention, "name", "stage"]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in (*done, over, last)])


def stage_rows(resolved: DataFrame) -> DataFrame:
    """(stage, rows_in, found): what each stage of `resolve` saw and knew."""
    n = {s: F.count_if(F.col("stage") == s) for s in (*STAGES, "over_budget", "unknown")}
    counts = resolved.agg(F.count(F.lit(1)).alias("all"), *[c.alias(s) for s, c in n.items()])
    rows_in = {"exact": F.col("all"), "folded": F.col("all") - F.col("exact"), "fuzzy": F.col("fuzzy") + F.col("unknown")}
    told = F.array(*[F.struct(F.lit(s).alias("stage"), rows_in[s].alias("rows_in"), F.col(s).alias("found")) for s in STAGES])
    return counts.select(F.explode(told).alias("x")).select("x.*")
