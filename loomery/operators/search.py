"""Constraint search: staged filters with survivor counts, what-ifs, ranking and diverse picks.

A search is an ordered list of named predicates over one candidate frame. Survivor counts of every
stage and of every relaxation come from one pass of conditional counts, so a what-if never reads the
candidates again.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import kept

Stages = dict[str, Column]


def true_only(c: Column) -> Column:
    """Unknown counts as no."""
    return F.coalesce(c, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return reduce(and_, [true_only(c) for c in conditions], F.lit(True))


def either(conditions: list[Column]) -> Column:
    return reduce(or_, [true_only(c) for c in conditions], F.lit(False))


def matching(candidates: DataFrame, stages: Stages, pinned: Column | None = None) -> DataFrame:
    """Candidates that pass every stage; pinned ones always do."""
    passes = every(list(stages.values()))
    return candidates.where(passes if pinned is None else passes | true_only(pinned))


def _as_rows(counts: DataFrame, names: list[str], key: str, extra: dict[str, list] | None = None) -> DataFrame:
    """One wide row of counts c0, c1, ... as a row per name."""
    structs = [F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias(key), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)]
    return counts.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def funnel(candidates: DataFrame, stages: Stages) -> DataFrame:
    """(step, stage, n): how many candidates survive the first 0, 1, ... stages."""
    conditions = list(stages.values())
    counts = candidates.agg(*[F.count_if(every(conditions[:i])).alias(f"c{i}") for i in range(len(conditions) + 1)])
    return _as_rows(counts, ["all", *stages], "stage")


def blocking_stage(candidates: DataFrame, stages: Stages) -> DataFrame:
    """The first stage that nothing survives (null if something survives all)."""
    return funnel(candidates, stages).agg(F.min_by("stage", F.when(F.col("n") == 0, F.col("step"))).alias("stage"), F.min(F.when(F.col("n") == 0, F.col("step"))).alias("step")).select(F.when(F.col("step").isNotNull(), F.col("stage")).alias("stage"), "step")


def relaxations(candidates: DataFrame, stages: Stages, together: int = 1) -> DataFrame:
    """(step, dropped, n): survivors without each choice of `together` stages."""
    choices = list(combinations(stages, together))
    counts = candidates.agg(*[F.count_if(every([c for n, c in stages.items() if n not in drop])).alias(f"c{i}") for i, drop in enumerate(choices)])
    return _as_rows(counts, ["+".join(c) for c in choices], "dropped")


def relax_in_order(candidates: DataFrame, stages: Stages, order: list[str]) -> DataFrame:
    """One row: how many of `order` must be dropped, one after another, until something is found; null if never."""
    counts = candidates.agg(*[F.count_if(every([c for n, c in stages.items() if n not in order[:i]])).alias(f"c{i}") for i in range(len(order) + 1)])
    rows = _as_rows(counts, ["+".join(order[:i]) for i in range(len(order) + 1)], "dropped").where("n > 0")
    return rows.agg(F.min("step").alias("step"), F.min_by("dropped", "step").alias("dropped"), F.min_by("n", "step").alias("n"))


def ranked(rows: DataFrame, keys: list[Column], out: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Rows numbered by the sort keys; give a unique key last."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*keys)).cast("long"))


def ranked_all(rows: DataFrame, keys: list[Column], out: str = "rank") -> DataFrame:
    """All rows numbered by the sort keys, without any task that holds them all.

    A distributed sort is written with the number of its part; parts are numbered inside, and the counts
    of the parts before are added.
    """
    parts = kept(rows.orderBy(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    joined = parts.join(sizes.select("__part", before.alias("__before")), "__part")  # a row a part
    return joined.withColumn(out, (F.col("__before") + inside).cast("long")).drop("__part", "__before")


def top(rows: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank; every task keeps no more than n."""
    return ranked(rows.orderBy(*keys).limit(n), keys)


#: Sort modes over a card frame: fixed orders of columns, nulls last. `id` settles ties.
SORT_MODES = {
    "recommendation": [("open", "desc"), ("favourite", "desc"), ("rating", "desc"), ("distance", "asc"), ("experience", "desc")],
    "rating": [("rating", "desc")],
    "experience": [("experience", "desc")],
    "distance": [("distance", "asc")],
    "schedule": [("open", "desc"), ("opens_at", "asc")],
    "price": [("price", "asc")],
    "name": [("name", "asc")],
    "place": [("place", "asc"), ("name", "asc")],
}


def sort_keys(mode: str, unique: str = "id") -> list[Column]:
    return [*(F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in SORT_MODES[mode]), F.asc(unique)]


def prefer(rows: DataFrame, group: list[str], preferred: Column) -> DataFrame:
    """Only the preferred rows of a group if it has any, else all; `narrowed` tells which."""
    any_ = F.bool_or(true_only(preferred)).over(Window.partitionBy(*group))
    return rows.withColumn("narrowed", any_).where(~F.col("narrowed") | true_only(preferred))


def suggestions(values: DataFrame, column: str, text: str, limit: int = 8) -> DataFrame:
    """Distinct values that contain the text: beginnings first, then shorter ones, then by name."""
    value = F.lower(F.trim(column))
    found = values.select(value.alias("value")).where(F.col("value").contains(text.lower())).distinct()
    keys = [F.desc(F.col("value").startswith(text.lower())), F.length("value"), F.col("value")]
    return top(found, keys, limit)


def disambiguate(rows: DataFrame, key: list[str], best: list[Column]) -> DataFrame:
    """The best row of each key and whether there were others."""
    w = Window.partitionBy(*key)
    out = rows.withColumns({"__r": F.row_number().over(w.orderBy(*best)), "ambiguous": F.count(F.lit(1)).over(w) > 1})
    return out.where("__r = 1").drop("__r")


def diverse_picks(rows: DataFrame, group: list[str], rank: str, person: str, place: str, k: int = 3, head: int = 12) -> DataFrame:
    """k rows of each group: first greedily by rank with new person and place, then with new person.

    Only the first `head` rows of each group are looked at for new places; people are looked for in the
    whole group. A person's best row is all that the second pass can take, and at most k people are taken
    before it, so the best rows of 2 k people suffice. What is picked depends on the picks before, so it
    is no window.
    """
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(rank))
    kept = list({*group, rank, person, place})
    first = rows.select(*kept).withColumn("__turn", turn).where(F.col("__turn") <= head).withColumn("__pass", F.lit(1))
    keys = list({*group, person})
    others = [c for c in kept if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(rank, *[c for c in others if c != rank])).alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in others])
    best = best.withColumn("__turn", turn).where(F.col("__turn") <= 2 * k).withColumn("__pass", F.lit(2))
    schema = T.StructType([*[rows.schema[g] for g in group], rows.schema[rank], T.StructField("pick", T.LongType())])

    def pick(block: pd.DataFrame) -> pd.DataFrame:
        people, places, taken = set(), set(), []
        for turn in (1, 2):
            for row in block[block["__pass"] == turn].sort_values("__turn").itertuples():
                who, where = getattr(row, person), getattr(row, place)
                if len(taken) < k and who not in people and not (turn == 1 and where in places):
                    taken.append(row.Index)
                    people.add(who)
                    places.add(where)
        out = block.loc[taken, [*group, rank]]
        return out.assign(pick=range(1, len(out) + 1))

    return first.unionByName(best).groupBy(*group).applyInPandas(pick, schema)


def page(rows: DataFrame, keys: list[Column], size: int, number: int) -> DataFrame:
    """A page of the rows with the total count beside each."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*keys).offset(size * number).limit(size).crossJoin(total)


def without_own(rows: DataFrame, stages: Stages, facet: str, value: str) -> DataFrame:
    """Counts of a facet's values among rows that pass every other stage."""
    return matching(rows, {n: c for n, c in stages.items() if n != facet}).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def services_for(services: Column, key: Column, visit: Column, exact: Column | None = None) -> Column:
    """The services that a visit means: the first or the repeat consultation of a key, procedures, or all; or the one that is named."""
    of = lambda kind: F.filter(services, lambda s: s == F.concat(F.lit("consult."), key, F.lit(f".{kind}")))
    meant = F.when(visit == "first", of("first")).when(visit == "repeat", of("repeat")).when(visit == "procedure", F.filter(services, lambda s: ~s.startswith("consult."))).otherwise(services)
    return meant if exact is None else F.when(exact.isNotNull(), F.filter(services, lambda s: s == exact)).otherwise(meant)


def affordable(services: Column, most: Column, covered_pass: Column) -> Column:
    """Of services (service, price, covered) those at most so dear; covered ones at any price where a plan is given."""
    return F.filter(services, lambda s: (covered_pass & F.coalesce(s["covered"], F.lit(False))) | F.coalesce(s["price"] <= most, F.lit(False)))


def travel_stage(candidates: DataFrame, times: DataFrame, place: str, most: int | None = None) -> DataFrame:
    """Candidates with the minutes to their place (null where it is not reached); with a ceiling only those within it."""
    out = candidates.join(times.select(place, "minutes"), place, "left")
    return out if most is None else out.where(F.col("minutes") <= most)


def option_maps(offers: DataFrame, keys: list[str], service: str, price: str, coverage: str) -> DataFrame:
    """Per option the map of its services' prices and that of their coverage."""
    return offers.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(service, price)))).alias("prices"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(service, coverage)))).alias("coverage"))


def without_reuse(steps: DataFrame, candidates: DataFrame, plan: str, step: str, on: list[str], entity: str, order: list[str], most_steps: int = 5) -> DataFrame:
    """(plan, step, entity): each step of a plan takes the best candidate that no step before it took; null if none is left.

    The first `most_steps` candidates of a step suffice, as no more can be taken before it. A plan of
    more steps is refused by `plan_errors`.
    """
    ranked_ = candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*on).orderBy(*order, entity))).where(F.col("__r") <= most_steps)
    best = ranked_.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", entity))), lambda x: x[entity]).alias("__c"))
    listed = steps.join(best, on, "left").groupBy(plan).agg(F.array_sort(F.collect_list(F.struct(F.col(step), F.col("__c")))).alias("__s"))
    kind = f"array<{candidates.schema[entity].dataType.simpleString()}>"
    free = lambda acc, s: F.get(F.filter(s["__c"], lambda c: ~F.exists(acc, lambda a: a.eqNullSafe(c))), 0)
    chosen = F.aggregate("__s", F.array().cast(kind), lambda acc, s: F.concat(acc, F.array(free(acc, s))))
    rows = listed.withColumn("__t", chosen).select(plan, F.posexplode(F.arrays_zip("__s", "__t")).alias("__i", "__x"))
    return rows.select(plan, F.col(f"__x.__s.{step}").alias(step), F.col("__x.__t").alias(entity))


def plan_errors(action: Column, steps: Column, tokens: Column, issued: Column, actions: list[str], most_steps: int = 5) -> Column:
    """The first reason to refuse a plan, null for none: action not allowed, too many steps, or a token that was not issued."""
    return (
        F.when(action.isNull() | ~action.isin(*actions), "unknown_action")
        .when(steps > most_steps, "too_many_steps")
        .when(F.size(F.array_except(tokens, issued)) > 0, "unknown_token")
    )


def sections(rows: DataFrame, pinned: Column, group: str, order: list[Column]) -> DataFrame:
    """section ('pinned' or the group), section_rank (pinned first, then by name) and place within it."""
    named = rows.withColumn("section", F.when(true_only(pinned), "pinned").otherwise(F.col(group)))
    names = named.select("section").distinct().withColumn("section_rank", F.dense_rank().over(Window.orderBy(F.when(F.col("section") == "pinned", 0).otherwise(1), "section")).cast("long"))
    return named.join(names, "section").withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order)).cast("long"))
