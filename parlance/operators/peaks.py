"""Unusual periods of actors, gathered into ranked peaks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.intervals import inside_days
from parlance.sources.shared import written


#: Features of a period that the forest cuts by, and rows that a tree is grown on.
FEATURES, SAMPLE = ("n", "rolling_mean", "rolling_std", "day_of_year"), 256


def path_length(m: Column) -> Column:
    """Mean length of a failed search among ``m`` values: what a leaf of so many rows adds to its depth."""
    m = m.cast("double")
    return F.when(m > 2, 2 * (F.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m).when(m == 2, 1.0).otherwise(0.0)


def isolation_scores(rows: DataFrame, trees: int = 200, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """``series, date, score`` of an isolation forest for each series (higher: easier to cut off); ``rows`` has (series, date, x), x an array of features.

    Nothing is drawn but by hashes of the seed, the series, the tree and the node, so that runs and engines agree. All trees of all
    series grow together, a level at a time: a node's rows choose one of the features that differ among its sample and a cut between
    its least and greatest value there. A tree has no more levels than the logarithm of its sample.
    """
    of_tree = Window.partitionBy("series", "tree")
    # few bytes, much work: a fixed number of parts, which aren't joined again for being small
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grown = rows.select("series", "date", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).repartition(parts, "series", "tree")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "series", F.col("tree").cast("string"), F.col("date").cast("string")))
    grown = grown.withColumn("size", F.least(F.lit(sample), F.count("*").over(of_tree))).withColumn("chosen", F.row_number().over(of_tree.orderBy(order, "date")) <= F.col("size"))
    grown = grown.withColumn("levels", F.length(F.bin(F.greatest(F.col("size"), F.lit(2)) - 1))).withColumn("node", F.lit(1).cast("long")).withColumn("depth", F.lit(None).cast("double"))
    features = range(len(FEATURES))
    inside = lambda f, k: f"{f}(if(chosen, x[{k}], null)) over (partition by series, tree, node)"
    hashed = lambda what: f"cast(conv(substring(md5(concat_ws('|', '{seed}', series, tree, node, '{what}')), 1, 8), 16, 10) as double) / 4294967296D"
    lows, highs = (f"array({', '.join(inside(f, k) for k in features)})" for f in ("min", "max"))
    leaf = "case when m > 2 then 2 * (ln(m - 1D) + 0.5772156649015329D) - 2 * (m - 1D) / m when m = 2 then 1D else 0D end"  # as path_length
    for level in range((sample - 1).bit_length() + 1):
        grown = grown.selectExpr("*", "count(if(chosen, 1, null)) over (partition by series, tree, node) as m", f"{lows} as low", f"{highs} as high")
        grown = grown.selectExpr(
            "series", "date", "x", "tree", "size", "chosen", "levels", f"filter(array({', '.join(map(str, features))}), k -> high[k] > low[k]) as wide", f"coalesce(depth, case when m <= 1 or levels <= {level} or size(wide) = 0 then {level}D + {leaf} end) as now",
            f"get(wide, cast(floor({hashed('feature')} * size(wide)) as int)) as by", f"get(low, by) + {hashed('cut')} * (get(high, by) - get(low, by)) as cut", "if(now is null, 2 * node + cast(get(x, by) >= cut as int), node) as node", "now as depth",
        ).drop("wide", "now", "by", "cut")
    mean = F.avg("depth") / F.greatest(path_length(F.max("size")), F.lit(1e-9))
    return grown.groupBy("series", "date").agg(F.round(F.pow(F.lit(2.0), -mean), 9).alias("score"))


def isolation_anomalies(features: DataFrame, by: list[str], trees: int = 200, contamination: float | None = 0.3, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """``score`` and ``is_anomaly`` of each period of each series.

    An anomaly scores above the quantile that leaves ``contamination`` of its series, and its number is above its baseline (null: it is not).
    Without ``contamination`` 15 periods of a series count, at most half of them.
    """
    cols = features.select(*by, "date", *FEATURES[:3], "baseline", FEATURES[3])
    named = written(cols.withColumn("series", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])), "features")
    x = F.array(*[F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 9) for c in FEATURES])
    scored = named.join(isolation_scores(named.select("series", "date", x.alias("x")), trees, seed, sample), ["series", "date"])
    w = Window.partitionBy("series")
    part = F.lit(contamination) if contamination is not None else F.least(F.lit(0.5), F.lit(15.0) / F.count("*").over(w))
    # the quantile stands between two ranked scores
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy("score", "date")) - 1).withColumn("at", (F.count("*").over(w) - 1) * (1 - part))
    score_at = lambda place: F.max(F.when(F.col("rank") == place, F.col("score"))).over(w)
    lined = ranked.withColumn("below", score_at(F.floor("at"))).withColumn("above", score_at(F.ceil("at"))).withColumn("line", F.col("below") + (F.col("above") - F.col("below")) * (F.col("at") - F.floor("at")))
    return lined.select(*cols.columns, "score", ((F.round("score", 9) > F.round("line", 9)) & F.coalesce(F.col("n") > F.col("baseline"), F.lit(False))).alias("is_anomaly"))


def with_floor(scored: DataFrame, by: list[str], k: float) -> DataFrame:
    """Anomalies stay whose score is no more than ``k`` deviations below the third quartile of the first anomalies."""
    w = Window.partitionBy(*by)
    first = F.when(F.col("is_anomaly"), F.col("score"))
    floor = F.percentile(first, F.lit(0.75)).over(w) - F.lit(k) * F.stddev_pop(first).over(w)
    return scored.withColumn("is_anomaly", F.col("is_anomaly") & F.coalesce(F.round("score", 9) >= F.round(floor, 9), F.lit(False)))


def prominences(values: list[float | None]) -> list[tuple[int, float]]:
    """(place, prominence) of each local maximum, the middle of a flat top; nulls are passed over but end no slope.

    On either side the lowest value on the way to the nearest higher one counts. One pass from each end keeps a stack of falling
    values with the lowest value since the one below, so that a value is pushed and taken off once.
    """

    def lows(places: range) -> dict[int, float]:
        stack: list[tuple[float, float]] = []
        out = {}
        for i in places:
            v = values[i]
            if v is None:
                continue
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            stack.append((v, low))
            out[i] = low
        return out

    n = len(values)
    left, right = lows(range(n)), lows(range(n - 1, -1, -1))
    out, lo = [], 0
    while lo < n:
        hi = lo
        while hi + 1 < n and values[hi + 1] == values[lo]:
            hi += 1
        around = values[lo - 1] if lo else None, values[hi + 1] if hi + 1 < n else None
        if values[lo] is not None and None not in around and max(around) < values[lo]:
            top = (lo + hi) // 2
            out.append((top, values[top] - max(left[top], right[top])))
        lo = hi + 1
    return out


def prominent(series: DataFrame, by: list[str], value: str = "share", least: float = 0.005) -> DataFrame:
    """Local maxima whose prominence is ``least`` or more; the middle of a flat top stands for it. A series is as long as its calendar and is gone through twice."""
    kinds = dict(series.dtypes)

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        tops = [(k, p) for k, p in prominences([None if v is None or v != v else v for v in table[value].to_pylist()]) if p >= least]
        kept = table.take(pa.array([k for k, _ in tops], pa.int64()))
        return kept.append_column("prominence", pa.array([p for _, p in tops], pa.float64()))

    rows = series.select(*by, "date", F.col(value).cast("double").alias(value))
    return rows.groupBy(*by).applyInArrow(found, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "date"]), f"`{value}` double", "prominence double"]))


def collapsed(flagged: DataFrame, totals: DataFrame, actor: str = "actor") -> DataFrame:
    """Flagged actor periods by date: counts and weights summed, actors listed, texts of all actors beside."""
    peaks = flagged.groupBy("date").agg(F.sum("n").alias("count"), F.sum("weight").alias("weight"), F.sort_array(F.collect_set(actor)).alias("actors"))
    out = peaks.join(totals.groupBy("date").agg(F.sum("n").alias("n_texts_total")), "date", "left")
    return out.withColumn("actors_engaged", F.size("actors")).withColumn("from_date", F.trunc("date", "MM")).withColumn("to_date", F.last_day("date"))


def without_dominated(peaks: DataFrame) -> DataFrame:
    """A period goes if the flagged period next to it, before or after, touches it and weighs as much or more (of equals both go)."""
    w = Window.orderBy("from_date")
    before = (F.date_add(F.lag("to_date").over(w), 1) == F.col("from_date")) & (F.lag("weight").over(w) >= F.col("weight"))
    after = (F.date_add(F.col("to_date"), 1) == F.lead("from_date").over(w)) & (F.lead("weight").over(w) >= F.col("weight"))
    return peaks.withColumn("__gone", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).filter("not __gone").drop("__gone")


def ranked(peaks: DataFrame, most: int = 15, more_than: int = 5) -> DataFrame:
    """The top periods by actors engaged and count, numbered by date."""
    top = peaks.filter(F.col("n_texts_total") > more_than).orderBy(F.desc("actors_engaged"), F.desc("count"), "from_date").limit(most)
    return top.withColumn("peak_id", F.row_number().over(Window.orderBy("from_date")))


def attached(series: DataFrame, peaks: DataFrame) -> DataFrame:
    """``peak_id`` and ``is_peak`` on every actor period."""
    small = peaks.select("date", "peak_id")
    return series.join(small, "date", "left").withColumn("is_peak", F.col("peak_id").isNotNull())


def peak_list(peaks: DataFrame) -> DataFrame:
    """One JSON object of peak number to first and last day."""
    entry = F.struct(F.col("peak_id").cast("string"), F.array(F.date_format("from_date", "yyyy-MM-dd"), F.date_format("to_date", "yyyy-MM-dd")))
    return peaks.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("peaks"))


def review_sheet(peaks: DataFrame) -> DataFrame:
    """Peaks with joined names and empty columns for annotation."""
    blank = [F.lit("").alias(c) for c in ("include_in_visualization", "title_short", "comment")]
    return peaks.select("peak_id", "from_date", "to_date", F.col("actors_engaged").alias("n_actors_engaged"), F.array_join("actors", ", ").alias("actors_names"), F.col("count").alias("n_texts_actors"), "n_texts_total", *blank, F.lit("open").alias("status"))


def ending_in(peaks: DataFrame, year: int, by: list[str]) -> DataFrame:
    return peaks.filter(F.year("to_date") == year).groupBy(*by).agg(F.sort_array(F.collect_list("peak_id")).alias("peak_ids"))


def approved(sheet: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Rows marked yes inside the range, renumbered by date; and the ids of the others."""
    yes = F.coalesce(F.lower(F.trim("include_in_visualization")) == "yes", F.lit(False))
    kept = sheet.filter(yes & (F.col("from_date") >= F.lit(start).cast("date")) & (F.col("to_date") < F.lit(end).cast("date")))
    renumbered = kept.withColumnRenamed("peak_id", "old_id").withColumn("peak_id", F.row_number().over(Window.orderBy("from_date", "old_id")))
    return renumbered, sheet.select("peak_id").join(kept.select("peak_id"), "peak_id", "left_anti")


def peak_text_counts(indexed: DataFrame, peaks: DataFrame, date: str = "publication_date") -> DataFrame:
    """Texts inside each peak's days."""
    met = inside_days(indexed.select(date), date, peaks.select("peak_id", "from_date", "to_date"))
    return met.groupBy("peak_id").agg(F.count("*").alias("n_texts"))


def deliverable(peaks: DataFrame, countries: dict[str, str], themes: dict[str, str]) -> DataFrame:
    """Peak rows with full names of country and theme."""
    names = lambda c, d: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(c)), F.col(c))
    return peaks.select(names("country", countries).alias("country"), names("theme", themes).alias("theme"), "peak_id", "from_date", "to_date", "count", "n_texts_total", "actors_engaged")
