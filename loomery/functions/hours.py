"""Opening hours: texts to intervals, and whether a place is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 24 * 60
_RANGE = r"(\d{1,2}):([0-5]\d)\s*[-–]\s*(\d{1,2}):([0-5]\d)"


def intervals(text: Column) -> Column:
    """array<struct<from, to>> of minutes: '9:00-13:00, 14:00-18:00'; an end at or before its start is on the
    next day; '24/7' is the whole day; other texts are no interval; null stays null.
    """
    part = lambda x, i: F.regexp_extract(x, _RANGE, i).cast("int")

    def one(x: Column) -> Column:
        begin, end = part(x, 1) * 60 + part(x, 2), part(x, 3) * 60 + part(x, 4)
        return F.struct(begin.alias("from"), F.when(end <= begin, end + DAY).otherwise(end).alias("to"))

    found = F.transform(F.regexp_extract_all(text, F.lit(_RANGE), F.lit(0)), one)
    fine = F.filter(found, lambda x: (x["from"] < DAY) & (x["to"] <= 2 * DAY))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.lit(DAY).alias("to")))
    made = F.when(F.trim(text) == "24/7", whole).when(text.isNotNull(), fine)
    return made.cast("array<struct<from:int,to:int>>")


def open_at(today: Column, yesterday: Column, minute: Column) -> Column:
    """Open at a minute of the day, by today's intervals or the tail of yesterday's; null when both are unknown."""
    inside = lambda at: lambda x: (x["from"] <= at) & (at < x["to"])
    now, tail = F.exists(today, inside(minute)), F.exists(yesterday, inside(minute + DAY))
    return F.when(today.isNull() & yesterday.isNull(), F.lit(None)).otherwise(F.coalesce(now, F.lit(False)) | F.coalesce(tail, F.lit(False)))


def works_after(day: Column, minute: int) -> Column:
    return F.exists(day, lambda x: x["to"] > minute)


def works_before(day: Column, minute: int) -> Column:
    return F.exists(day, lambda x: x["from"] < minute)


def evening_until(day: Column, minute: int = 20 * 60) -> Column:
    """Evening by the card's definition: an interval lasts to 20:00 or later."""
    return F.exists(day, lambda x: x["to"] >= minute)


def evening_after(day: Column, minute: int = 18 * 60) -> Column:
    """Evening by the search's definition: an interval ends after 18:00."""
    return works_after(day, minute)


def in_windows(minute: Column, windows: list[tuple[int, int]]) -> Column:
    """Any of [from, to) holds the minute."""
    out = F.lit(False)
    for a, b in windows:
        out = out | ((minute >= a) & (minute < b))
    return out


WEEK = ("mo", "tu", "we", "th", "fr", "sa", "su")
CLOSED = r"(?i)^\s*(off|closed|day off)\s*$"


def works_weekend(week: Column) -> Column:
    """A map by day names a weekend day, and not as closed; false without a map."""
    known = lambda d: F.coalesce(~F.try_element_at(week, F.lit(d)).rlike(CLOSED), F.lit(False))
    return F.coalesce(known("sa") | known("su"), F.lit(False))


#: What a text of rules is made of: whole days, spans of time, names, single signs.
_LEXEME = r"24/7|day\s+off|\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2}|\p{L}+|\S"
_RULE_STATE = "struct<days:array<int>,reach:boolean,laid:boolean,holiday:boolean,fine:boolean,known:boolean,week:array<string>>"


def _read(state: Column, token: Column) -> Column:
    """One token further: days gather until hours are laid over them, and a day after hours begins the next rule."""
    day = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in WEEK]), token).cast("int"), F.lit(0))
    part = lambda i: F.regexp_extract(token, r"^(\d{1,2}):(\d{2})\D+(\d{1,2}):(\d{2})$", i).try_cast("int")
    timed = F.coalesce((part(1) <= 24) & (part(3) <= 24) & (part(2) < 60) & (part(4) < 60), F.lit(False))
    shut = token.isin("off", "closed") | token.rlike(r"^day\s+off$")
    hours = F.when(shut, "closed").when(token == "24/7", "00:00-24:00").when(timed, F.format_string("%02d:%02d-%02d:%02d", part(1), part(2), part(3), part(4)))
    named = day > 0
    anew = state["laid"] & (named | (token == "ph")) | (token == ";")
    none = F.array().cast("array<int>")
    held = F.when(anew, none).otherwise(state["days"])
    last = F.element_at(state["days"], -1)
    reached = F.transform(F.sequence(F.lit(1), F.pmod(day - last, F.lit(7))), lambda i: (last + i - 1) % 7 + 1)
    days = F.when(named & state["reach"] & (day != last), F.concat(held, reached)).when(named, F.concat(held, F.array(day))).otherwise(held)
    holiday = (token == "ph") | (state["holiday"] & ~anew)
    over = F.when(F.size(days) > 0, days).when(holiday, none).otherwise(F.sequence(F.lit(1), F.lit(7)))
    more = state["laid"] & ~anew & ~shut
    week = F.transform(state["week"], lambda w, i: F.when(hours.isNotNull() & F.array_contains(over, i + 1), F.when(more, F.concat(w, F.lit(","), hours)).otherwise(hours)).otherwise(w))
    reach = token == "-"
    odd = (state["reach"] & ~named) | (reach & ((F.size(state["days"]) == 0) | state["laid"])) | ((token == ";") & ~state["laid"] & (F.size(state["days"]) > 0))
    readable = named | hours.isNotNull() | token.isin("ph", "-", ",", ";")
    laid = hours.isNotNull() | (state["laid"] & ~anew)
    known = state["known"] | (hours.isNotNull() & (F.size(over) > 0))
    return F.struct(days.alias("days"), reach.alias("reach"), laid.alias("laid"), holiday.alias("holiday"), (state["fine"] & readable & ~odd).alias("fine"), known.alias("known"), week.alias("week")).cast(_RULE_STATE)


def week_map(text: Column) -> Column:
    """map from day to the text of its hours, by rules like 'Mo-Fr 08:00-18:00; Sa 09:00-13:00; Su off'.

    The text is read token by token: days and ranges of days (which may wrap), then spans of time, 'off' or '24/7'
    for them. Later rules go over earlier ones, hours without days hold every day, rules for holidays alone are
    passed over, and what follows '||' is a comment. Days that no rule names are closed. Null where something can't
    be read (an hour above 24 or a minute above 59 among it), where days have no hours, or where no day is named.
    """
    clean = F.lower(F.trim(F.get(F.split(text, r"\|\|"), F.lit(0))))
    shut = F.array(*[F.lit("closed")] * 7)
    begin = F.struct(F.array().cast("array<int>"), F.lit(False), F.lit(False), F.lit(False), F.lit(True), F.lit(False), shut).cast(_RULE_STATE)
    end = F.aggregate(F.regexp_extract_all(clean, F.lit(_LEXEME), F.lit(0)), begin, _read)
    fine = end["fine"] & end["known"] & ~end["reach"] & (end["laid"] | (F.size(end["days"]) == 0))
    return F.when(fine, F.map_from_arrays(F.array(*[F.lit(d) for d in WEEK]), end["week"]))
