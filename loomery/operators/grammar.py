"""Conditions said in an English text, read token by token, and dialogues with questions that wait for an answer.

The tokens of a text are numbers, clock times, words and the signs that end clauses. They are folded in order over one
state: what a keyword waits for, the number that waits for its unit, whether a negation rules, and
the fields so far. A negation rules the rest of its clause, so a list of values falls under it whole, up to a full stop,
a semicolon, a line's end, `but` or `only`; a comma ends what a keyword waits for and not the negation. The last value that
is affirmed wins. The same fold made of built-in functions takes a millisecond a token, ten times what
it takes here, so tokens are made in the JVM and folded in batches behind it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import _fold, _with

LEXEME = r"\d+(?::\d{2})?|\p{L}+|[.!?;,\n]"
#: Words of the grammar: fixed values.
NEGATORS = ("not", "no", "never", "except", "without", "avoid", "dont")
ENDS = (".", "!", "?", ";", "\n", "but", "only")
DAYS = {d: (d,) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")} | {
    "weekend": ("saturday", "sunday"), "weekdays": ("monday", "tuesday", "wednesday", "thursday", "friday")}
WANTS = {"after": "after", "from": "after", "before": "before", "until": "before", "by": "before", "under": "price", "below": "price", "most": "price", "cheaper": "price", "least": "least", "over": "least", "within": "within", "show": "show", "find": "show"}
GENDERS = {"female": "female", "woman": "female", "lady": "female", "male": "male", "man": "male"}
MODES = {"car": "driving", "drive": "driving", "driving": "driving", "bike": "bike", "cycling": "bike", "foot": "foot", "walk": "foot", "walking": "foot"}
VISITS = {"first": "first", "repeat": "repeat", "follow": "repeat"}
SORTS = {"cheapest": "price", "nearest": "distance", "earliest": "soonest", "best": "rating"}
UNITS = {"am": "am", "pm": "pm", "minutes": "minutes", "minute": "minutes", "min": "minutes", "years": "years", "year": "years", "results": "results", "options": "results"}
FIELDS = {"days": "array<string>", "not_days": "array<string>", "after": "int", "before": "int", "most_price": "long", "gender": "string", "experience": "int", "travel_minutes": "int", "travel_mode": "string", "visit": "string", "sort": "string", "limit": "int"}
_SAID = "|".join(sorted({*NEGATORS, "but", "only", *DAYS, *(f"{d}s" for d in list(DAYS)[:7]), *WANTS, *GENDERS, *MODES, *VISITS, *SORTS, *UNITS}))
_TELLING = rf"\d|(?<!\p{{L}})(?:{_SAID})(?!\p{{L}})"
_DAY_OF = DAYS | {f"{d}s": v for d, v in list(DAYS.items())[:7]}
_PICKS = {w: (field, v) for field, words in (("gender", GENDERS), ("travel_mode", MODES), ("visit", VISITS), ("sort", SORTS)) for w, v in words.items()}
CONDITIONS = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if k.startswith("array") else T.LongType() if k == "long" else T.IntegerType() if k == "int" else T.StringType()) for n, k in FIELDS.items()])


def _number_ends(out: dict, number: str, want: str | None, unit: str | None) -> None:
    """A number that waited gets its unit, or none, and its field."""
    hour, _, minute = number.partition(":")
    first = int(hour)
    if want in ("after", "before") and unit in (None, "am", "pm"):
        clock = first % 12 + 12 if unit == "pm" else first % 12 if unit == "am" else first
        if clock < 24 and int(minute or 0) < 60:
            out[want] = clock * 60 + int(minute or 0)
    elif want == "price" and unit is None:
        out["most_price"] = first
    elif want == "least" and unit == "years":
        out["experience"] = first
    elif unit == "minutes" and want in ("within", "price", "before"):
        out["travel_minutes"] = first
    elif (want == "show" and unit is None) or unit == "results":
        out["limit"] = first


def conditions_of(tokens: list[str]) -> tuple:
    """FIELDS of the tokens of a text, in one pass over them."""
    out: dict = dict.fromkeys(FIELDS)
    days, excluded = set(), set()
    want = number = None
    negated = False
    for token in [*tokens, "."]:
        if number is not None:
            if not negated:
                _number_ends(out, number, want, UNITS.get(token))
            if token not in WANTS and not token[0].isdigit():
                want = None
            number = None
        if token[0].isdigit():
            number = token if len(token) <= 9 else None
        elif token in ENDS:
            want, negated = None, False
        elif token == ",":
            want = None
        elif token in NEGATORS:
            negated = True
        elif token in WANTS:
            want = WANTS[token]
        elif token in _DAY_OF:
            (excluded if negated else days).update(_DAY_OF[token])
            (days if negated else excluded).difference_update(_DAY_OF[token])
        elif token in _PICKS and not negated:
            out[_PICKS[token][0]] = _PICKS[token][1]
    week = list(DAYS)[:7]
    return [d for d in week if d in days], [d for d in week if d in excluded], *(out[n] for n in list(FIELDS)[2:])


@F.pandas_udf(CONDITIONS)
def _conditions(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([conditions_of(list(t)) for t in tokens], columns=CONDITIONS.names, dtype=object)


def conditions(text: Column) -> Column:
    """struct of FIELDS: days (Monday first) and excluded days, minutes of the day, price, gender, years of experience, travel, visit, order and number of results.

    Nothing said is null, or an empty array. `by` is a time before a number and names nothing before a mode of
    travel, which is known by itself. A null text says nothing. Clauses are cut, and those that say nothing left out,
    by built-in functions; numbers of more than nine characters say nothing.
    """
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", ""))
    # a clause without a number or a word of the grammar leaves the state as it is
    clauses = F.filter(F.split(low, r"[.!?;\n]"), lambda c: c.rlike(_TELLING))
    return _conditions(F.regexp_extract_all(F.array_join(clauses, "."), F.lit(LEXEME), F.lit(0)))


def dialogue(turns: DataFrame, key: str, order: str, asked: str, said: str, said_value: str, bare: str) -> DataFrame:
    """turns with field, value (what a turn settles) and pending (the field that waits for an answer after it).

    asked: the field that a turn asks for, or null. said and said_value: a field that a turn names with its value. bare: a
    value without a field. A question waits until its field is settled, or another question takes its place; a
    bare value settles the field that waits and is nothing where none does. A turn that names a field
    settles that one, and the question only if it was for it. A dialogue is read in order as a stream.
    """

    def some(value):
        return None if value is None or value != value else value

    def step(pending, row):
        field, value = some(getattr(row, said)), some(getattr(row, said_value))
        answer, question = some(getattr(row, bare)), some(getattr(row, asked))
        if field is None and answer is not None and pending is not None:
            field, value = pending, answer
        elif field is None:
            value = None
        if field is not None and field == pending:
            pending = None
        pending = question or pending
        return pending, (field, value, pending)

    return _fold(turns, [key], order, step, lambda: None, _with(turns, field=T.StringType(), value=T.StringType(), pending=T.StringType()))


def settled(told: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, a column a field): the last value that each field was settled with."""
    last = lambda f: F.max_by("value", F.when(F.col("field") == f, F.col(order)))
    return told.groupBy(key).agg(*[last(f).alias(f) for f in fields])
