"""Heads of groups, duplicates and prominences against plain sorting and scanning; hot keys."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from parlance.operators import peaks, profiling, sampling, top
from parlance.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def least(v, falling):
    """A key that sorts nulls as the least and NaN as the greatest."""
    place = (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    return (-place[0], [-ord(c) for c in place[1]] + [0] if isinstance(place[1], str) else -place[1]) if falling else place


@pytest.mark.parametrize("falling", [True, False])
def test_heads_of_groups(spark, falling):
    draw = random.Random(7)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None, ""]), draw.choice([1, 2, None]), draw.choice([None, float("nan"), -0.5, draw.random()]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, v double, k int").repartition(7)
    found = top.top_rows(df, ["g", "h"], [("v", falling), ("k", not falling)], 4, "rank")
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    want = [(*r, i + 1) for own in groups.values() for i, r in enumerate(sorted(own, key=lambda r: (least(r[2], falling), r[3] if falling else -r[3]))[:4])]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert "Window" not in found._jdf.queryExecution().toString()


def test_heads_are_handed_on_and_merged(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 1500 as g", "id as v").repartition(3)
    whole = sorted(map(tuple, top.top_rows(df, ["g"], [("v", True)], 2).collect()))
    assert whole == sorted((k % 1500, k) for k in range(5000) if k >= 2000)
    one = top.top_rows(df, [], [("v", True)], 3, "place").collect()
    assert [(r.v, r.place) for r in one] == [(4999, 1), (4998, 2), (4997, 3)] and one[0].asDict().keys() == {"g", "v", "place"}
    assert top.top_rows(df.limit(0), ["g"], [("v", True)], 2).count() == 0


def test_one_hot_pair_is_spread(spark):
    df = spark.range(0, 40_000, 1, 8).selectExpr("id as doc_id", "case when id % 20 = 0 then concat('s', id % 7) else 'hot' end as source", "'en' as lang")
    out = [r.doc_id for r in sampling.round_robin(df, 30, ["source", "lang"], "doc_id").collect()]
    assert len(set(out)) == 30
    # each task hands on the heads of its groups only
    heads = top.top_rows(df, ["source"], [("doc_id", False)], 5)
    assert heads.filter("source = 'hot'").agg(F.collect_list("doc_id")).first()[0].__len__() == 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["round_robin_sample", "top_terms_per_lang", "float_examples", "date_examples"])
def test_plans_have_no_window(spark, name):
    if name in plans.QUERIES:
        assert "Window [" not in plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_duplicates_of_one_row_many_times(spark):
    df = spark.range(0, 300_000, 1, 8).selectExpr("id", "case when id < 250000 then 'same' else cast(id div 2 as string) end as t", "cast(null as string) as u")
    out = profiling.duplicate_rows(df, "id")
    assert out.count() == 300_000
    assert out.filter("first_id = 0").agg(F.countDistinct("occurrence"), F.max("occurrence"), F.max("group_size"), F.sum((F.col("occurrence") == F.col("id") + 1).cast("int"))).first()[:] == (250_000, 250_000, 250_000, 250_000)
    assert out.filter("first_id > 0").agg(F.max("occurrence"), F.max("group_size")).first()[:] == (2, 2)


def slow(values):
    out, lo = [], 0
    while lo < len(values):
        hi = lo
        while hi + 1 < len(values) and values[hi + 1] == values[lo]:
            hi += 1
        if lo and hi + 1 < len(values) and max(values[lo - 1], values[hi + 1]) < values[lo]:
            k, v = (lo + hi) // 2, values[lo]
            left = next((i for i in range(k, -1, -1) if values[i] > v), -1)
            right = next((i for i in range(k, len(values)) if values[i] > v), len(values))
            out.append((k, v - max(min(values[left + 1 : k + 1]), min(values[k:right]))))
        lo = hi + 1
    return out


def test_prominences():
    draw = random.Random(2)
    for n in [0, 1, 2, 3, 50, 300]:
        for _ in range(20):
            values = [draw.choice([draw.randrange(6), draw.random()]) for _ in range(n)]
            assert peaks.prominences(values) == slow(values)
    assert peaks.prominences([1, 3, None, 2, 4, 1, 5, 5, 2]) == [(4, 3), (6, 3)]


def test_prominent_series_of_a_hundred_thousand_periods(spark):
    draw = random.Random(3)
    walk, v = [], 0.0
    for _ in range(100_000):
        v += draw.uniform(-1, 1)
        walk.append(v)
    began = time.perf_counter()
    found = peaks.prominences(walk)
    assert time.perf_counter() - began < 5 and len(found) > 10_000
    rows = [("a", dt.date(1, 1, 1) + dt.timedelta(days=k), x) for k, x in enumerate(walk)] + [(None, dt.date(2000, 1, 1) + dt.timedelta(days=k), x) for k, x in enumerate([0.0, 1.0, 0.5, 2.0, 0.0])]
    out = peaks.prominent(spark.createDataFrame(rows, "actor string, date date, share double"), ["actor"], least=5.0).collect()
    assert sorted((r.date - dt.date(1, 1, 1)).days for r in out) == sorted(k for k, p in found if p >= 5.0)
