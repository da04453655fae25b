"""Local days at a fixed offset, reporting periods and their buckets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET_HOURS = 3
#: Longest span of a period, and bucket by span: fixed values (days).
MAX_DAYS, HOUR_DAYS, DAY_DAYS, WEEK_DAYS = 800, 2, 92, 400


def local(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return ts + F.expr(f"INTERVAL {hours} HOURS")


def local_day(ts: Column) -> Column:
    return F.to_date(local(ts))


def local_hour(ts: Column) -> Column:
    return F.hour(local(ts))


def local_weekday(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(local(ts))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


@dataclass(frozen=True)
class Period:
    """Local instants [start, end) and the bucket its series is told in."""

    start: datetime
    end: datetime
    bucket: str

    @property
    def previous(self) -> Period:
        """The same length immediately before, not the calendar's predecessor."""
        return Period(self.start - (self.end - self.start), self.start, self.bucket)

    def buckets(self) -> list[datetime]:
        """Starts of the buckets that the period touches."""
        out, at = [], floor_to(self.start, self.bucket)
        while at < self.end:
            out.append(at)
            at = next_start(at, self.bucket)
        return out


def floor_to(at: datetime, bucket: str) -> datetime:
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    if bucket == "hour":
        return at.replace(minute=0, second=0, microsecond=0)
    if bucket == "week":
        return day - timedelta(days=day.weekday())
    return day.replace(day=1) if bucket == "month" else day


def next_start(at: datetime, bucket: str) -> datetime:
    if bucket == "month":
        return at.replace(year=at.year + at.month // 12, month=at.month % 12 + 1)
    return at + {"hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(days=7)}[bucket]


def bucket_for(start: datetime, end: datetime) -> str:
    days = (end - start) / timedelta(days=1)
    return "hour" if days <= HOUR_DAYS else "day" if days <= DAY_DAYS else "week" if days <= WEEK_DAYS else "month"


def calendar_date(text: str) -> date | None:
    """A real calendar date in ISO form; 2024-02-30 is none."""
    try:
        return date.fromisoformat(text) if len(text) == 10 else None
    except ValueError:
        return None


def period(preset: str, now: datetime, start: str | None = None, end: str | None = None, bucket: str | None = None) -> Period:
    """today, yesterday, 7d, 30d, 90d, week, month, prev_month, year, or custom with ISO days (end included)."""
    day = floor_to(now, "day")
    spans = {
        "today": (day, now),
        "yesterday": (day - timedelta(days=1), day),
        "7d": (day - timedelta(days=6), now),
        "30d": (day - timedelta(days=29), now),
        "90d": (day - timedelta(days=89), now),
        "week": (floor_to(now, "week"), now),
        "month": (floor_to(now, "month"), now),
        "prev_month": (floor_to(floor_to(now, "month") - timedelta(days=1), "month"), floor_to(now, "month")),
        "year": (day.replace(month=1, day=1), now),
    }
    if preset == "custom":
        first, last = calendar_date(start or ""), calendar_date(end or "")
        if first is None or last is None or first > last:
            raise ValueError("a custom period needs two calendar dates in order")
        a = datetime(first.year, first.month, first.day)
        b = min(datetime(last.year, last.month, last.day) + timedelta(days=1), now)
        if b - a > timedelta(days=MAX_DAYS):
            raise ValueError(f"a period has at most {MAX_DAYS} days")
        if b <= a:
            raise ValueError("the period has not begun")
    elif preset in spans:
        a, b = spans[preset]
    else:
        raise ValueError(f"unknown period {preset}")
    return Period(a, b, bucket or bucket_for(a, b))


def dense(counts: DataFrame, key: str, starts: DataFrame, fill: dict[str, int]) -> DataFrame:
    """counts by bucket with a row for every start, `fill` where there is none."""
    return starts.join(counts, key, "left").fillna(fill)


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row per day from first to last, both included."""
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")


def resolve_days(spark: SparkSession, today: date, window: int = 14, only: list[str] | None = None, not_on: list[str] | None = None) -> DataFrame:
    """(day, weekday) of a scheduling window: symbols narrow it, exclusions take days out.

    today, tomorrow, this_week (today to Sunday), next_week (the seven days after that), weekend,
    workday, mon..sun, or ISO dates. Weekdays count from 1, Monday.
    """
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    to_sunday = 6 - today.weekday()

    def match(symbol: str) -> Column:
        ahead, day_no = F.datediff("day", F.lit(today)), F.col("weekday")
        if symbol == "today":
            return ahead == 0
        if symbol == "tomorrow":
            return ahead == 1
        if symbol == "this_week":
            return ahead <= to_sunday
        if symbol == "next_week":
            return (ahead > to_sunday) & (ahead <= to_sunday + 7)
        if symbol == "weekend":
            return day_no >= 6
        if symbol == "workday":
            return day_no <= 5
        if symbol in names:
            return day_no == names.index(symbol) + 1
        return F.col("day") == F.lit(symbol).cast("date")

    days = days_between(spark, today.isoformat(), (today + timedelta(days=window - 1)).isoformat()).withColumn("weekday", F.weekday("day") + 1)
    for symbols, keep in ((only, True), (not_on, False)):
        if symbols:
            some = match(symbols[0])
            for s in symbols[1:]:
                some = some | match(s)
            days = days.where(some if keep else ~some)
    return days


def ready_at(start: Column, hours: Column) -> Column:
    """When a result that takes `hours` from `start` is there; null without both."""
    return F.when(hours > 0, start + F.make_dt_interval(hours=hours.cast("int")))


def days_to_ready(hours: Column, opens: int = 9, closes: int = 20) -> Column:
    """Days from a visit at `opens` until a result is there while open; null for no positive number of hours."""
    ready = hours + opens
    return F.when(hours > 0, (F.floor(ready / 24) + (ready % 24 > closes).cast("int")).cast("int"))


def rounded_up_clock(minute: Column, hours: Column, step: int = 5) -> Column:
    """The minute of the day `hours` from now, up to a step of minutes, at most midnight."""
    return F.least(F.ceil((minute + hours * 60) / step) * step, F.lit(24 * 60)).cast("int")
