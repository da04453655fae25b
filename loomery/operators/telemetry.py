"""Operations statistics: rollups, latency histograms, percentiles, dense series, periods, active users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import LATENCY_BOUNDS, average, bin_of, change, half_up

UP_TO = (Window.unboundedPreceding, Window.currentRow)


def rollup(requests: DataFrame, hour: Column, endpoint: Column, latency: Column, failed: Column) -> DataFrame:
    """Per hour and endpoint: count, failures, total latency (hundredths) and the bins b0..b9."""
    bins = bin_of(latency)
    counted = [F.count_if(bins == i).alias(f"b{i}") for i in range(len(LATENCY_BOUNDS) + 1)]
    return requests.groupBy(hour.alias("hour"), endpoint.alias("endpoint")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"), F.sum(half_up(latency * 100).cast("long")).alias("total_cs"), *counted)


def histogram_percentiles(bins: DataFrame, keys: list[str], bin_column: str, count: str, fractions: list[float], bounds=LATENCY_BOUNDS) -> DataFrame:
    """Upper bound of the bin in which the running count reaches ceil(total * fraction); the overflow bin tells the last bound."""
    order = Window.partitionBy(*keys).orderBy(bin_column)
    summed = bins.withColumns({"__upto": F.sum(count).over(order.rowsBetween(*UP_TO)), "__total": F.sum(count).over(Window.partitionBy(*keys))})
    upper = F.element_at(F.array(*[F.lit(b) for b in (*bounds, bounds[-1])]), F.col(bin_column) + 1)
    found = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * F.lit(f)), upper)).cast("long").alias(f"p{round(f * 100)}") for f in fractions]
    return summed.groupBy(*keys).agg(F.sum(count).cast("long").alias("n"), *found)


def nearest_rank(samples: DataFrame, keys: list[str], value: str, order: list[Column], last: int, fractions: list[float]) -> DataFrame:
    """Of the last N samples of each key, the value at index min(n - 1, floor(n * fraction))."""
    recent = samples.withColumn("__turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__turn") <= last)
    ranked = recent.withColumns({"__i": F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    at = [F.max(F.when(F.col("__i") == F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(f))), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions]
    return ranked.groupBy(*keys).agg(F.max("__n").cast("long").alias("n"), *at)


def peak(counts: DataFrame, count: str, start: str, keys: list[str] | None = None) -> DataFrame:
    """The row with the largest count, the earliest of equals."""
    order = Window.partitionBy(*(keys or [])).orderBy(F.desc(count), start)
    return counts.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def compare(rows: DataFrame, keys: list[str], period: Column, measures: dict[str, Column]) -> DataFrame:
    """Each measure in this period and the one before (period: 'now', 'before' or null), with the change in percent."""
    tagged = rows.withColumn("__p", period).where("__p is not null")
    sums = []
    for name, c in measures.items():
        sums += [F.coalesce(F.sum(F.when(F.col("__p") == p, c)), F.lit(0)).cast("long").alias(f"{name}_{p}") for p in ("now", "before")]
    out = tagged.groupBy(*keys).agg(*sums)
    return out.withColumns({f"{n}_change": change(F.col(f"{n}_now"), F.col(f"{n}_before")) for n in measures})


def running_total(per_bucket: DataFrame, bucket: str, count: str, opening: int | Column = 0) -> DataFrame:
    """Cumulative count with an opening balance."""
    base = F.lit(opening) if isinstance(opening, int) else opening
    return per_bucket.withColumn("total", (base + F.sum(count).over(Window.orderBy(bucket).rowsBetween(*UP_TO))).cast("long"))


def active_users(activity: DataFrame, user: str, day: str, last: Column, spans: dict[str, int]) -> DataFrame:
    """Distinct users in the last 1, 7, 30 ... days up to `last`; each is distinct over its whole span."""
    ahead = F.datediff(last, F.col(day))
    return activity.agg(*[F.count_distinct(F.when((ahead >= 0) & (ahead < n), F.col(user))).alias(name) for name, n in spans.items()])


def positive_deltas(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """delta of a cumulative counter; a reset or a first sample gives 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return samples.withColumn("delta", F.greatest(F.coalesce(F.col(value) - before, F.lit(0)), F.lit(0)))


def sliding_share(rows: DataFrame, keys: list[str], at: str, cost: str, span: int, most: float) -> DataFrame:
    """cost_in_span over the last `span` units of `at` (inclusive), and whether it exceeds most * span."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-span, 0)
    out = rows.withColumn("cost_in_span", F.sum(cost).over(w))
    return out.withColumn("over", F.col("cost_in_span") > F.lit(most * span))


def key_cap(rows: DataFrame, period: str, key: str, order: str, cap: int, other: str = "unknown") -> DataFrame:
    """Keys after the first `cap` that a period saw fold into `other`."""
    seen = rows.groupBy(period, key).agg(F.min(order).alias("__first"))
    seen = seen.withColumn("__turn", F.row_number().over(Window.partitionBy(period).orderBy("__first", key)))
    named = seen.withColumn("capped", F.when(F.col("__turn") <= cap, F.col(key)).otherwise(F.lit(other)))
    return rows.join(named.select(period, key, "capped"), [period, key])


def status_rollup(requests: DataFrame, hour: Column, endpoint: Column, status: Column, latency_cs: Column) -> DataFrame:
    """Per hour and endpoint: count, status classes, 429s apart, and the average latency as a whole number."""
    classes = [F.count_if((F.floor(status / 100) == k) & (status != 429)).alias(f"s{k}xx") for k in (2, 3, 4, 5)]
    out = requests.groupBy(hour.alias("hour"), endpoint.alias("endpoint")).agg(F.count(F.lit(1)).alias("n"), *classes, F.count_if(status == 429).alias("s429"), F.sum(latency_cs).cast("long").alias("total"))
    return out.withColumn("average", average(F.col("total"), F.col("n")))


def last_hours(events: DataFrame, ts: Column, failed: Column, now: Column, hours: int = 24) -> DataFrame:
    """(hours_ago, n, failures) of each of the last hours by the clock, the running one too: minutes first, then hours, then gaps filled."""
    minutes = events.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"))
    ago = F.timestamp_diff("HOUR", F.date_trunc("hour", F.col("minute")), F.date_trunc("hour", now)).cast("int")
    per_hour = minutes.withColumn("hours_ago", ago).where(F.col("hours_ago").between(0, hours - 1)).groupBy("hours_ago").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"))
    every = events.sparkSession.range(hours).select(F.col("id").cast("int").alias("hours_ago"))
    return every.join(per_hour, "hours_ago", "left").fillna(0, ["n", "failures"])
