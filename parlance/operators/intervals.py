"""Joins of points with intervals of days and with rectangles, by equal keys.

An interval of length L lies in at most two bins of the least power of two over L, so it is written once or twice, at the level
of its length. A row looks into one bin of every level that is in use. The exact test comes after; no pair meets twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(df: DataFrame, level: str) -> list[int]:
    """The levels in use: a few dozen numbers at most, for days, and no more than a double has exponents, for coordinates."""
    return sorted(r[0] for r in df.select(level).distinct().collect())


def _each(levels: list[int]) -> Column:
    return F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)"))


def inside_days(rows: DataFrame, day: str, intervals: DataFrame, first: str = "from_date", last: str = "to_date") -> DataFrame:
    """``rows`` beside every interval that holds their day, ends included. Rows without a day and intervals without an end, or that end before they begin, meet nothing."""
    lo, hi = F.unix_date(F.col(first).cast("date")), F.unix_date(F.col(last).cast("date"))
    cut = intervals.withColumns({"__lo": lo, "__hi": hi}).filter("__lo <= __hi").withColumn("__level", F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.length(F.bin(F.col("__hi") - F.col("__lo")))).cast("int"))
    cut = cut.withColumn("__bin", F.explode(F.sequence(F.expr("shiftright(__lo, __level)"), F.expr("shiftright(__hi, __level)"))))
    looked = rows.withColumn("__day", F.unix_date(F.col(day).cast("date"))).filter("__day is not null").withColumn("__level", _each(_levels(cut, "__level"))).withColumn("__bin", F.expr("shiftright(__day, __level)"))
    met = looked.join(cut, ["__level", "__bin"]).filter("__day between __lo and __hi")
    return met.drop("__level", "__bin", "__lo", "__hi", "__day")


#: Exponent of the tiles of regions that are a point, and of those without end.
POINT, ENDLESS = -40, 1100


def inside_boxes(points: DataFrame, boxes: DataFrame, x: str = "x", y: str = "y", names: tuple[str, str, str, str] = ("x_lower", "x_upper", "y_lower", "y_upper")) -> DataFrame:
    """``points`` beside every closed rectangle that holds them; rectangles may share points, be a point or have no end."""
    x0, x1, y0, y1 = (F.col(n).cast("double") for n in names)
    side = F.greatest(x1 - x0, y1 - y0)
    level = F.when(F.isnan(side) | (side > 1e300), ENDLESS).when(side <= 2.0**POINT, POINT).otherwise(F.ceil(F.log2(side)) + 1).cast("int")
    size = F.pow(F.lit(2.0), F.col("__level").cast("double"))
    tile = lambda c: F.floor(c.cast("double") / size)
    cut = boxes.filter((x0 <= x1) & (y0 <= y1)).withColumn("__level", level)
    cut = cut.withColumn("__tx", F.explode(F.sequence(tile(x0), tile(x1)))).withColumn("__ty", F.explode(F.sequence(tile(y0), tile(y1))))
    looked = points.withColumn("__level", _each(_levels(cut, "__level"))).withColumns({"__tx": tile(F.col(x)), "__ty": tile(F.col(y))})
    met = looked.join(cut, ["__level", "__tx", "__ty"]).filter(F.col(x).cast("double").between(x0, x1) & F.col(y).cast("double").between(y0, y1))
    return met.drop("__level", "__tx", "__ty")


def merged(ranges: list[tuple[str | None, str | None]]) -> list[tuple[str | None, str | None]]:
    """Ranges of ISO days as few that don't meet, in order; those that end before they begin are skipped, null ends are open."""
    low, high = "", "~"  # before and after every day
    out: list[list[str]] = []
    for a, b in sorted((a or low, b or high) for a, b in ranges if not (a and b and a > b)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a or None, None if b == high else b) for a, b in out]


