"""Search requests: a closed record, its checks, the conditions said in a text, and the search itself."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grammar, phrases, search
from .graph import kept


@dataclass(frozen=True)
class Request:
    """What a search may ask for; every field is optional. Unknown fields and values outside their range are errors."""

    kinds: tuple[str, ...] = ()
    cities: tuple[int, ...] = ()
    not_cities: tuple[int, ...] = ()
    most_price: int | None = None
    least_rating: float | None = None
    least_size: int | None = None
    most_size: int | None = None
    sort: str = "recommendation"
    limit: int = 5
    pinned: tuple[int, ...] = field(default=())

    @staticmethod
    def read(raw: dict) -> tuple[Request, list[str]]:
        known = {f.name for f in fields(Request)}
        errors = [f"unknown field {k}" for k in raw if k not in known]
        made = Request(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known})
        for name, low, high in (("most_price", 0, 10**9), ("least_rating", -(10**6), 10**6), ("limit", 1, 50)):
            value = getattr(made, name)
            if value is not None and not (isinstance(value, int | float) and low <= value <= high):
                errors.append(f"{name} is out of range")
                made = replace(made, **{name: getattr(Request(), name)})
        if made.sort not in search.SORT_MODES:
            errors.append("sort is unknown")
            made = replace(made, sort="recommendation")
        if set(made.cities) & set(made.not_cities):
            errors.append("a city is both wanted and excluded")
        return made, errors

    def stages(self) -> search.Stages:
        """Predicates in fixed order, only those asked for. An unknown city fails both lists."""
        c = F.col
        out: search.Stages = {}
        if self.kinds:
            out["kind"] = c("kind").isin(*self.kinds)
        if self.cities:
            out["city"] = c("city").isin(*self.cities)
        if self.not_cities:
            out["not_city"] = c("city").isNotNull() & ~c("city").isin(*self.not_cities)
        if self.least_rating is not None:
            out["rating"] = F.coalesce(c("rating"), F.lit(0.0)) >= self.least_rating
        if self.least_size is not None or self.most_size is not None:
            out["size"] = c("size").between(self.least_size or 0, self.most_size if self.most_size is not None else 10**9)
        if self.most_price is not None:
            out["price"] = c("price") <= self.most_price
        return out


def find(candidates: DataFrame, request: Request, keys: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the best matches with rank, survivors by stage, what dropping one condition would find)."""
    stages = request.stages()
    pinned = F.col("id").isin(*request.pinned) if request.pinned else None
    best = search.top(search.matching(candidates, stages, pinned), keys, request.limit)
    return best, search.funnel(candidates, stages), search.relaxations(candidates, stages) if stages else search.funnel(candidates, stages)


#: Words of an English request: fixed values.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_NOT = r"(?:not|no|never|except|without|avoid)\s+(?:on\s+|in\s+|the\s+)?"
_HOUR = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
CONDITIONS = T.StructType().add("days", T.ArrayType(T.StringType())).add("not_days", T.ArrayType(T.StringType())).add("after", "integer").add("before", "integer").add("most_price", "long").add("gender", "string").add("experience", "integer")


def _minute(hour: str, minute: str | None, half: str | None) -> int | None:
    h = int(hour) % 12 + 12 if half == "pm" else int(hour) % 12 if half == "am" else int(hour)
    return h * 60 + int(minute or 0) if h < 24 else None


def conditions_of(text: str) -> dict:
    """Days, times, price, gender and experience said in an English text; the last affirmed value of each wins."""
    low = text.lower()
    days, excluded = [], []
    for m in re.finditer(rf"({_NOT})?\b({'|'.join(WEEKDAYS)}|weekend|weekdays)s?\b", low):
        (excluded if m[1] else days).append(m[2])
    last = lambda found: found[-1] if found else None
    price = last([m[1] for m in re.finditer(r"(?:under|below|up to|at most|cheaper than)\s+(\d[\d ]*\d|\d)", low)])
    gender = last([m[2] for m in re.finditer(rf"({_NOT})?\b(female|male|woman|man)\b", low) if not m[1]])
    years = last([m[1] for m in re.finditer(r"(?:at least|over|more than)\s+(\d{1,2})\s+years", low)])
    return {
        "days": sorted(set(days) - set(excluded)),
        "not_days": sorted(set(excluded)),
        "after": last([_minute(*m.groups()) for m in re.finditer(rf"\b(?:after|from)\s+{_HOUR}(?!\s*years)\b", low)]),
        "before": last([_minute(*m.groups()) for m in re.finditer(rf"\b(?:before|until|by)\s+{_HOUR}\b", low)]),
        "most_price": int(price.replace(" ", "")) if price else None,
        "gender": {"woman": "female", "man": "male"}.get(gender, gender),
        "experience": int(years) if years else None,
    }


@F.pandas_udf(CONDITIONS)
def conditions(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([conditions_of(t or "") for t in text], columns=CONDITIONS.names)


def fold_turns(turns: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """State after a conversation: of each field the last value that a turn gave."""
    return turns.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def day_of_month(today: Column, day: Column, months: int = 3) -> Column:
    """The next date with that day of the month, not before today and within `months`; null if there is none."""
    firsts = F.transform(F.sequence(F.lit(0), F.lit(months)), lambda i: F.add_months(F.trunc(today, "month"), i))
    dates = F.transform(firsts, lambda f: F.when(day <= F.dayofmonth(F.last_day(f)), F.date_add(f, day - 1)))
    return F.array_min(F.filter(dates, lambda d: d.isNotNull() & (d >= today) & (d <= F.add_months(today, months))))


def hour_readings(hour: Column, bound: Column) -> Column:
    """Minutes that a bare hour may mean: 1 to 7 are afternoon, 8 to 11 both unless it is a lower bound, others as said."""
    as_said, later = hour * 60, (hour + 12) * 60
    return F.when(hour.between(1, 7), F.array(later)).when(hour.between(8, 11) & (bound != "from"), F.array(as_said, later)).otherwise(F.array(as_said))


def windows_of(start: Column, end: Column) -> Column:
    """(from, to) pairs of all readings of two hours that make a window."""
    pairs = F.flatten(F.transform(hour_readings(start, F.lit("from")), lambda a: F.transform(hour_readings(end, F.lit("to")), lambda b: F.struct(a.alias("from"), b.alias("to")))))
    return F.filter(pairs, lambda p: p["from"] < p["to"])


def round_up(minute: Column, step: int = 5) -> Column:
    return (F.ceil(minute / F.lit(step)) * step).cast("int")


def next_days(today: date, n: int) -> tuple[date, date]:
    """The n days from today."""
    return today, today + timedelta(days=n - 1)


def fold_with_retractions(turns: DataFrame, key: str, order: str, columns: list[str], taken_back: str) -> DataFrame:
    """State after a conversation, where the word `taken_back` takes a field's value back; and how many turns did so."""
    retracts = F.lit(False)
    for c in columns:
        retracts = retracts | F.coalesce(F.col(c) == taken_back, F.lit(False))
    folded = [F.nullif(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), F.lit(taken_back)).alias(c) for c in columns]
    return turns.groupBy(key).agg(*folded, F.count_if(retracts).alias("retracted"))


def chat_search(texts: DataFrame, keys: list[str], text: str, rules: DataFrame, flags: DataFrame, context: DataFrame, candidates: DataFrame, least: float = 0.3, k: int = 3) -> DataFrame:
    """(keys, state, flag, specialty, rank, id): from what a text says to the k best candidates, in one plan.

    The text is triaged by phrases and its conditions are read by the grammar, each once, into a table; candidates are met by equality on the
    specialty, and every condition that was said must hold. candidates: id, specialty, gender, price, experience, days (array),
    opens and closes (minutes of the day); what is unknown of a candidate fails a condition on it. Ranked by price
    where the cheapest are asked for, else by experience, then price, then id; at most `limit` of the text, if it names
    one. state: emergency (a flag, nothing is searched), unclear (no specialty with a confidence of `least`), found, or nothing.
    Texts without candidates have one row with a null rank.
    """
    said = texts.select(*keys, grammar.conditions(F.col(text)).alias("c"))
    plan = kept(phrases.triage(texts, keys, text, rules, flags, context)).join(said, keys)
    clear = F.col("flag").isNull() & (F.size("labels") > 0) & (F.col("confidence") >= least)
    plan = kept(plan.select(*keys, "flag", F.when(clear, F.get("labels", F.lit(0))).alias("specialty"), "c"))  # read twice
    met = plan.where("specialty IS NOT NULL").join(candidates, "specialty")
    if_said = lambda field, fits: F.col(f"c.{field}").isNull() | F.coalesce(fits, F.lit(False))
    fits = if_said("gender", F.col("gender") == F.col("c.gender")) & if_said("most_price", F.col("price") <= F.col("c.most_price")) & if_said("experience", F.col("experience") >= F.col("c.experience"))
    fits &= if_said("after", F.col("closes") > F.col("c.after")) & if_said("before", F.col("opens") < F.col("c.before"))
    open_days = F.array_except("days", "c.not_days")
    fits &= F.when(F.size("c.days") > 0, F.arrays_overlap(open_days, "c.days")).otherwise((F.size("c.not_days") == 0) | (F.size(open_days) > 0))
    cheap = F.when(F.col("c.sort") == "price", F.col("price"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(cheap), F.desc_nulls_last("experience"), F.asc_nulls_last("price"), "id")
    most = F.least(F.lit(k), F.coalesce("c.limit", F.lit(k)))
    best = met.where(F.coalesce(fits, F.lit(False))).select(*keys, "id", most.alias("__most"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).where(F.col("rank") <= F.col("__most"))
    out = plan.drop("c").join(best.drop("__most"), keys, "left")
    state = F.when(F.col("flag").isNotNull(), "emergency").when(F.col("specialty").isNull(), "unclear").when(F.col("rank").isNotNull(), "found").otherwise("nothing")
    return out.select(*keys, state.alias("state"), "flag", "specialty", "rank", "id")
