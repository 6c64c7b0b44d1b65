"""Joins with intervals and rectangles against every pair; plans without nested loops."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from parlance.operators import intervals, timeseries, vectors
from parlance.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def test_days_in_intervals_of_all_lengths(spark):
    draw = random.Random(3)
    day = lambda: dt.date(1960, 1, 1) + dt.timedelta(days=draw.randrange(30_000))
    spans = []
    for k in range(200):
        a = day()
        spans.append((k, a, a + dt.timedelta(days=draw.choice([0, 1, 2, 6, 27, 31, 364, 5000, 20_000]))))
    spans += [(900, dt.date(2000, 1, 2), dt.date(2000, 1, 1)), (901, None, day()), (902, day(), None), (903, *spans[0][1:])]
    rows = [(k, day()) for k in range(400)] + [(1000, None), (1001, spans[0][1]), (1002, spans[0][2])]
    df, iv = spark.createDataFrame(rows, "id int, day date"), spark.createDataFrame(spans, "peak int, from_date date, to_date date")
    found = intervals.inside_days(df, "day", iv)
    assert sorted((r.id, r.peak) for r in found.collect()) == sorted((i, p) for i, d in rows for p, a, b in spans if d and a and b and a <= d <= b)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.columns == ["id", "day", "peak", "from_date", "to_date"]
    assert intervals.inside_days(df, "day", iv.limit(0)).count() == 0 and intervals.inside_days(df.limit(0), "day", iv).count() == 0


def test_points_in_rectangles_of_all_sizes(spark):
    draw = random.Random(4)
    inf = float("inf")
    boxes = []
    for k in range(150):
        x, y, s = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice([0.0, 1e-13, 1e-3, 0.5, 1.0, 30.0, 1e6])
        boxes.append((f"b{k}", x, x + s * draw.random(), y, y + s))
    boxes += [("all", -inf, inf, -inf, inf), ("right", 0.0, inf, -1e308, 1e308), ("inverted", 2.0, 1.0, 0.0, 5.0), ("none", 1.0, None, 0.0, 1.0), ("unit", 0.0, 1.0, 0.0, 1.0), ("unit", 0.0, 1.0, 0.0, 1.0), ("far", 1e200, 1.1e200, 0.0, 1.0)]
    points = [(draw.uniform(-60, 60), draw.uniform(-60, 60)) for _ in range(500)] + [(b[1], b[3]) for b in boxes[:40]] + [(0.0, 0.0), (1.0, 1.0), (-0.0, 1.0), (float("nan"), 0.0), (1e308, 1.0), (1.05e200, 0.5)]
    df = spark.createDataFrame(points, "x double, y double")
    regions = spark.createDataFrame(boxes, "area string, x_lower double, x_upper double, y_lower double, y_upper double")
    out = {r.area: (r.n_points, r.status) for r in vectors.region_counts(df, regions).collect()}
    want = {}
    for name, a, b, c, d in boxes:
        if b is not None:
            n = sum(a <= x <= b and c <= y <= d for x, y in points)
            want[name] = (n, "invalid" if a > b or c > d else "ok" if n else "empty")
    assert out == want and want["all"][0] == len(points) - 1


def test_merged_ranges():
    ranges = [("2020-05-01", "2020-06-01"), (None, "2019-01-01"), ("2020-06-01", "2020-07-01"), ("2022-01-01", "2021-01-01"), ("2018-01-01", "2018-02-01"), ("2023-01-01", None), ("2024-01-01", "2024-02-01")]
    assert intervals.merged(ranges) == [(None, "2019-01-01"), ("2020-05-01", "2020-07-01"), ("2023-01-01", None)]
    assert intervals.merged([(None, None), ("2020-01-01", None)]) == [(None, None)] and intervals.merged([]) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["date_ranges", "peak_join", "peak_text_counts", "peak_texts", "region_counts"])
def test_plans_have_no_nested_loops(spark, name):
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_many_ranges_are_few_filters(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=k),) for k in range(400)], "d date")
    ranges = [(str(dt.date(2020, 1, 1) + dt.timedelta(days=k)), str(dt.date(2020, 1, 1) + dt.timedelta(days=k + 2))) for k in range(0, 200)]
    found = timeseries.in_ranges(df, "d", ranges)
    assert found.count() == 202 and found._jdf.queryExecution().optimizedPlan().toString().count("<=") < 6
