"""Calendar counts, rolling features, smoothing and layers of activity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.intervals import merged

#: How a period starts and how far the next one is.
PERIODS = {"D": ("day", "interval 1 day"), "W": ("week", "interval 7 days"), "2W": ("week", "interval 14 days"), "ME": ("month", "interval 1 month"), "2ME": ("month", "interval 2 months"), "QE": ("quarter", "interval 3 months"), "YE": ("year", "interval 1 year")}


def between(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Half-open range of days."""
    return df.filter((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))


def between_or_null(df: DataFrame, date: str, start: str | None, end: str | None, newest_first: bool = False, drop_null: bool = False) -> DataFrame:
    """Inclusive range that keeps rows without a date (unless ``drop_null``), sorted on request."""
    kept = F.lit(True)
    if start:
        kept &= F.col(date) >= F.lit(start).cast("date")
    if end:
        kept &= F.col(date) <= F.lit(end).cast("date")
    out = df.filter(F.col(date).isNotNull() & kept if drop_null else F.col(date).isNull() | kept)
    return out.orderBy(F.col(date).desc_nulls_last()) if newest_first else out


def in_ranges(df: DataFrame, date: str, ranges: list[tuple[str | None, str | None]]) -> DataFrame:
    """Rows inside any of the inclusive ranges; ends may be open, ranges that end before they start are skipped. Ranges that meet are one filter, which the scan can use."""
    kept = F.lit(False)
    for a, b in merged(ranges):
        one = F.col(date).isNotNull()
        if a:
            one &= F.col(date) >= F.lit(a).cast("date")
        if b:
            one &= F.col(date) <= F.lit(b).cast("date")
        kept |= one
    return df.filter(kept)


def without_source(df: DataFrame, source: str | Column, part: str) -> DataFrame:
    return df.filter(~F.coalesce(F.lower(source).contains(part.lower()), F.lit(False)))


def days_of(start: str, end: str, period: str) -> Column:
    """The last days of the periods that start between the days, periods anchored at the calendar's start."""
    unit, step = PERIODS[period]
    first = f"date_trunc('{unit}', date'{start}')"
    return F.expr(f"transform(sequence(cast({first} as date), date'{end}', {step}), lo -> date_sub(cast(lo + {step} as date), 1))")


def period_end(date: str, start: str, period: str) -> Column:
    """Last day of the period that holds a day."""
    unit, step = PERIODS[period]
    if period in ("2W", "2ME"):
        first = f"cast(date_trunc('{unit}', date'{start}') as date)"
        if period == "2W":
            return F.expr(f"date_add({first}, 14 * cast(floor(datediff({date}, {first}) / 14) as int) + 13)")
        k = f"cast(floor(months_between(cast(date_trunc('month', {date}) as date), {first}) / 2) as int)"
        return F.expr(f"date_sub(add_months({first}, 2 * {k} + 2), 1)")
    return F.expr(f"date_sub(cast(cast(date_trunc('{unit}', {date}) as date) + {step} as date), 1)")


def period_counts(df: DataFrame, date: str, by: list[str], start: str, end: str, period: str = "ME", weight: str | None = None) -> DataFrame:
    """Rows per period and group over the whole calendar, zero where there are none; with ``weight`` also the sum of 1 / weight."""
    days = F.explode(days_of(start, end, period)).alias("date")
    counts = df.filter(F.col(date).isNotNull()).groupBy(*by, period_end(date, start, period).alias("date"))
    counts = counts.agg(F.count("*").alias("n"), *([F.sum(1 / F.col(weight)).alias("weighted")] if weight else []))
    grid = (df.select(*by).distinct() if by else df.sparkSession.range(1)).select(*by, days)
    joined = grid.join(counts, [*by, "date"], "left")
    return joined.select(*by, "date", F.coalesce("n", F.lit(0)).alias("n"), *([F.coalesce("weighted", F.lit(0.0)).alias("weighted")] if weight else []))


def own_span_counts(df: DataFrame, date: str, period: str = "ME") -> DataFrame:
    """Rows per period between the first and the last period with data."""
    unit, step = PERIODS[period]
    days = df.filter(F.col(date).isNotNull()).groupBy(F.expr(f"cast(date_trunc('{unit}', {date}) as date)").alias("lo")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("lo").alias("a"), F.max("lo").alias("b")).select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("lo"))
    return span.join(days, "lo", "left").select(F.expr(f"date_sub(cast(lo + {step} as date), 1)").alias("date"), F.coalesce("n", F.lit(0)).alias("n"))


def rolling_features(series: DataFrame, by: list[str], window: int = 10, least: int = 2) -> DataFrame:
    """Rolling mean and deviation, the mean before (baseline) and the day of the year; gaps of the mean are filled from the next, then the last value."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = w.rowsBetween(-window + 1, 0)
    mean = F.when(F.count("n").over(rows) >= least, F.avg("n").over(rows))
    out = series.withColumn("raw_mean", mean).withColumn("rolling_std", F.coalesce(F.when(F.count("n").over(rows) >= least, F.stddev_samp("n").over(rows)), F.lit(0.0)))
    out = out.withColumn("baseline", F.lag("raw_mean").over(w)).withColumn("day_of_year", F.dayofyear("date"))
    after, before = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("rolling_mean", F.coalesce(F.first("raw_mean", True).over(after), F.last("raw_mean", True).over(before))).drop("raw_mean")


def shares(series: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """Each value by the total of its group."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return series.withColumn("share", F.when(total > 0, F.col(value) / total))


def engagement(series: DataFrame, prior: float = 10.0) -> DataFrame:
    """``share`` of an actor's total and ``weight``, which shrinks the shares of actors with few texts."""
    share = F.when(F.col("total_texts") > 0, F.col("n") / F.col("total_texts")).otherwise(F.lit(0.0))
    return series.withColumn("share", share).withColumn("weight", share * F.col("total_texts") / (F.col("total_texts") + prior))


def smoothed(series: DataFrame, by: list[str], value: str, sigma: float = 2.0, radius: int = 6) -> DataFrame:
    """Gaussian smoothing with the edge values repeated beyond the ends."""
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(kernel)
    w = Window.partitionBy(*by).orderBy("date")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(ends), F.last(value).over(ends)
    parts = []
    for k in range(-radius, radius + 1):
        shifted = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        parts.append(F.coalesce(shifted, first if k < 0 else last) * (kernel[k + radius] / total))
    return series.withColumn("smooth", sum(parts[1:], parts[0]))


def layers(series: DataFrame, actor: str, weight: str = "weight") -> DataFrame:
    """Lower and upper edge of each actor's layer around the middle line, heavy actors first; ``peak_y`` is the upper edge of all."""
    rank = series.groupBy(actor).agg(F.sum(weight).alias("__total")).select(actor, F.row_number().over(Window.orderBy(F.desc("__total"), actor)).alias("actor_rank"))
    joined = series.join(rank, actor)
    day = Window.partitionBy("date")
    total = F.sum(weight).over(day)
    below = F.coalesce(F.sum(weight).over(day.orderBy("actor_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return joined.withColumn("lower", -total / 2 + below).withColumn("upper", F.col("lower") + F.col(weight)).withColumn("peak_y", total / 2)


def by_weight(series: DataFrame, actor: str, weight: str = "weight") -> list[str]:
    """Actors, heaviest first (of equals by name): the order of their columns. Actors are few."""
    totals = series.groupBy(actor).agg(F.sum(weight).alias("w")).orderBy(F.desc("w"), actor)
    return [r[0] for r in totals.collect()]


def wide(series: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """One column per value, zero where there is nothing."""
    return series.groupBy(row).pivot(column, values).agg(F.sum(value)).fillna(0, [str(v) for v in values])
