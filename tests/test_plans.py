"""Registered queries on rows that the driver's tables don't have."""

from __future__ import annotations

import datetime as dt

from parlance.plans import queries as plans


def test_each_page_comes_back_once(spark, tmp_path):
    rows = [(1, "http://a.example/x", "<h1>A</h1>"), (2, "http://a.example/x", "<h1>B</h1>"), (3, None, "<h1>C</h1>"), (4, "http://a.example/y", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = plans.QUERIES["web_standardise"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.article_title) for r in out if r.page_id < 4) == [(1, "A"), (2, "B"), (3, "C")] and len(out) == 4


def test_flat_tops_are_peaks(spark, tmp_path):
    counts = [1, 5, 5, 5, 2, 4, 1]
    rows = [("a", dt.datetime(2024, 1, k + 1, 12)) for k, n in enumerate(counts) for _ in range(n)]
    spark.createDataFrame(rows, "event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    out = plans.QUERIES["prominence_peaks"](spark, str(tmp_path)).collect()
    assert {(r.date, r.prominence) for r in out} == {("2024-01-03", round(4 / 23, 6)), ("2024-01-06", round(2 / 23, 6))}
