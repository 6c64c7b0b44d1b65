"""Calendars, peaks and samples."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import peaks, sampling, timeseries, vectors


def test_periods_cover_the_calendar(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 31)), ("a", dt.date(2020, 3, 1)), ("b", None)], "actor string, day date")
    out = timeseries.period_counts(df, "day", ["actor"], "2020-01-01", "2020-04-30").orderBy("actor", "date").collect()
    assert [(r.actor, str(r.date), r.n) for r in out][:4] == [("a", "2020-01-31", 1), ("a", "2020-02-29", 0), ("a", "2020-03-31", 1), ("a", "2020-04-30", 0)]
    assert [r.n for r in out][4:] == [0, 0, 0, 0]


def test_every_period_keeps_every_row(spark):
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=k),) for k in range(0, 360, 7)]
    df = spark.createDataFrame(days, "day date")
    for period in timeseries.PERIODS:
        out = timeseries.period_counts(df, "day", [], "2020-01-01", "2020-12-31", period)
        assert out.agg(F.sum("n")).first()[0] == len(days), period


def test_ranges(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2021, 1, 1),), (None,)], "d date")
    assert timeseries.between(df, "d", "2020-01-01", "2021-01-01").count() == 1
    assert timeseries.between_or_null(df, "d", "2020-06-01", None).count() == 2
    assert timeseries.between_or_null(df, "d", "2020-06-01", None, drop_null=True).count() == 1
    assert timeseries.in_ranges(df, "d", [(None, "2020-06-01"), ("2022-01-01", "2021-01-01")]).count() == 1


def test_smoothing_keeps_a_constant(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d), 3.0) for d in range(1, 20)], "actor string, date date, w double")
    out = timeseries.smoothed(df, ["actor"], "w").collect()
    assert all(abs(r.smooth - 3) < 1e-9 for r in out)


def test_adjacent_peaks(spark):
    rows = [(dt.date(2020, m, 1), w) for m, w in ((1, 1.0), (2, 2.0), (3, 2.0), (5, 1.0))]
    df = spark.createDataFrame(rows, "from_date date, weight double").withColumn("to_date", F.last_day("from_date"))
    assert [r.from_date.month for r in peaks.without_dominated(df).collect()] == [5]


def test_prominence_of_flat_tops(spark):
    values = [0, 1, 3, 3, 3, 1, 2, 1, 5, 0]
    df = spark.createDataFrame([("a", dt.date(2020, 1, k + 1), float(v)) for k, v in enumerate(values)], "actor string, date date, share double")
    out = {r.date.day: r.prominence for r in peaks.prominent(df, ["actor"], least=0.5).collect()}
    assert out == {4: 2.0, 7: 1.0, 9: 5.0}


def test_isolation_scores_the_spike_highest(spark):
    draw = np.random.default_rng(1)
    rows = [(s, dt.date(2000, 1, 1) + dt.timedelta(days=k), [9.0 if k == 40 else float(v) for v in draw.normal(1, 0.05, 4)]) for s in ("a", "b") for k in range(80)]
    rows += [("one", dt.date(2000, 1, 1), [1.0] * 4)] + [("flat", dt.date(2000, 1, k + 1), [2.0] * 4) for k in range(9)]
    df = spark.createDataFrame(rows, "series string, date date, x array<double>").repartition(5)
    out = {(r.series, r.date): r.score for r in peaks.isolation_scores(df, 60, 7).collect()}
    for s in ("a", "b"):
        assert max((v, d) for (t, d), v in out.items() if t == s)[1] == dt.date(2000, 2, 10)
    assert {v for (s, _), v in out.items() if s == "flat"} == {0.5} and all(0 < v <= 1 for v in out.values()) and len(out) == len(rows)
    assert {(r.series, r.date): r.score for r in peaks.isolation_scores(df.repartition(2), 60, 7).collect()} == out
    assert {(r.series, r.date): r.score for r in peaks.isolation_scores(df, 60, 8).collect()} != out


def test_isolation_on_series(spark):
    rows = [("a", dt.date(2015, 1, 1) + dt.timedelta(days=31 * k), 50 if k == 30 else 5) for k in range(60)]
    df = timeseries.rolling_features(spark.createDataFrame(rows, "actor string, date date, n long"), ["actor"])
    out = peaks.isolation_anomalies(df, ["actor"], trees=50, contamination=0.1).filter("is_anomaly").collect()
    assert any(r.n == 50 for r in out) and all(r.n > r.baseline for r in out) and len(out) <= 7


def test_round_robin_is_even(spark):
    rows = [(k, "a" if k % 5 else "b", None if k % 3 else "web") for k in range(100)]
    out = sampling.round_robin(spark.createDataFrame(rows, "id int, actor string, platform string"), 40, ["actor", "platform"], "id")
    counts = sorted(r["count"] for r in out.groupBy("actor", "platform").count().collect())
    assert sum(counts) == 40 and counts[-1] - counts[0] <= 6
    assert sampling.round_robin(spark.createDataFrame(rows, "id int, actor string, platform string"), 500, ["actor", "platform"], "id").count() == 100


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    points = [(k, [float(x) for x in rng.normal(10 * (k % 2), 0.05, 3)]) for k in range(40)] + [(99, [50.0, 50.0, 50.0])]
    out = {r.id: r.cluster for r in vectors.density_clusters(spark.createDataFrame(points, "id int, v array<double>"), "id", "v", epsilon=0.5).collect()}
    assert out[99] == -1 and len({out[k] for k in range(0, 40, 2)}) == 1 and len({out[k] for k in range(40)}) == 2


def test_approved_peaks(spark):
    rows = [(1, dt.date(2020, 5, 1), " YES "), (2, dt.date(2020, 1, 1), "yes"), (3, dt.date(2020, 2, 1), "no"), (4, dt.date(2030, 1, 1), "yes")]
    sheet = spark.createDataFrame(rows, "peak_id int, from_date date, include_in_visualization string").withColumn("to_date", F.last_day("from_date"))
    kept, gone = peaks.approved(sheet, "2015-01-01", "2026-01-01")
    assert [(r.old_id, r.peak_id) for r in kept.orderBy("peak_id").collect()] == [(2, 1), (1, 2)]
    assert sorted(r.peak_id for r in gone.collect()) == [3, 4]
