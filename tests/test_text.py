"""Patterns, keywords, sentences, dates and small columns on literal rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import columns, dates, patterns
from parlance.operators import chunks, keywords


@pytest.mark.parametrize(
    ("keyword", "text", "found"),
    [
        ("bøss*", "BØSSER og bøsse", ["BØSSER", "bøsse"]),
        ("*tion", "nation, nations", ["nation"]),
        ("*on*", "nation", ["on"]),
        ("gay", "Ögay gay", ["gay"]),
        ("woke-", "woke-, woken", ["woke-"]),
        ("anti*woke", "antisuperwoke anti woke", ["antisuperwoke"]),
        ("a.b", "axb a.b", ["a.b"]),
    ],
)
def test_wildcards(spark, keyword, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(F.expr(keywords.hits("t", keyword)).alias("h")).first()
    assert row.h == found


def test_refused_patterns(spark):
    good, bad = patterns.valid_patterns(spark, ["ok*", "fine"])
    assert list(good) == ["ok*", "fine"] and bad == []


def test_sentences_keep_empty_fragments(spark):
    out = keywords.sentences(spark.createDataFrame([(1, "a. b\n\nc."), (2, "  "), (3, None)], "id int, text string")).orderBy("sentence_id").collect()
    assert [(r.id, r.sentence_id, r.sentence) for r in out] == [(1, 1, "a"), (1, 2, " b"), (1, 3, "c"), (1, 4, "")]


def test_match_orders_and_false_positives(spark):
    df = spark.createDataFrame([("Thing thing THING ration",), ("nothing",), (None,)], "sentence string")
    rows = keywords.match(df, ["thing*", "*tion"], [" RATION "]).collect()
    assert rows[0].matched_words == ["THING", "Thing", "thing"] and rows[0].matched_keywords == ["thing*"] and rows[0].matched == 1
    assert rows[1].matched_keywords is None and rows[1].matched_words == [] and rows[1].matched == 0
    assert rows[2].matched == 0


def test_index_keeps_order_of_discovery(spark):
    df = spark.createDataFrame([(1, 2, None, ["b", "a"], ["B"], 1), (1, 1, "x", ["c"], ["C", "B"], 1), (1, 3, "y", [], [], 0)], "id int, sentence_id int, source string, matched_keywords array<string>, matched_words array<string>, matched int")
    row = keywords.index(df, "id", ["source"]).first()
    assert (row.source, row.matched_keywords, row.matched_words) == ("x", ["c", "b", "a"], ["C", "B"])


def test_pairs_and_annotation(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "c"],)], "w array<string>")
    of = lambda *pairs: [r.x for r in df.select(keywords.keyword_pairs(F.col("w"), list(pairs)).alias("x")).collect()]
    assert of(("a", "b")) == [["a", "b", "c"], ["c"]]
    assert of(("a", "b"), ("a", "d")) == [["b", "c", "a"], ["c"]] and of(("a", "d"), ("c", "b", "a")) == [["b", "c", "a"], []]
    assert of(("a", "c", "b"), ("x", "y")) == [["a", "b", "c"], []] and of() == [["a", "b", "c"], ["a", "c"]]
    found = keywords.annotation_match(spark.createDataFrame([("a thing here.",), ("thing",)], "text string"), ["thing"]).collect()
    assert [r.matched_keywords for r in found] == [["thing"]]


def test_mask(spark):
    df = spark.createDataFrame([("Thing things Bob.bob x",)], "t string").select(keywords.masked("t", ["thing*"], "lgb").alias("m"), keywords.actor_masked("t", "'bob.bob'").alias("a"))
    assert df.first().m == "[LGB] [LGB] Bob.bob x" and df.first().a == "Thing things   x"


def test_dates(spark):
    df = spark.createDataFrame([("2024-03-02",), ("03/02/2024",), ("2 March 2024",), ("20240302",), ("",), ("soon",), (None,)], "t string")
    out = df.select(dates.parsed_date(F.col("t")).alias("m"), dates.parsed_date(F.col("t"), F.lit(True)).alias("d")).collect()
    assert [str(r.m) for r in out] == ["2024-03-02", "2024-03-02", "2024-03-02", "2024-03-02", "None", "None", "None"]
    assert str(out[1].d) == "2024-02-03"


def test_relative_and_video_dates(spark):
    df = spark.createDataFrame([("Idag 10:30", "20250608"), ("igår", "x"), ("2020-01-01", None)], "t string, v string")
    out = df.select(dates.relative_date(F.col("t"), F.lit("2024-05-01")).alias("r"), dates.video_date(F.col("v")).alias("v")).collect()
    assert [tuple(r) for r in out] == [("2024-05-01 10:30", "2025-06-08"), ("2024-04-30", "x"), ("2020-01-01", None)]


def test_columns(spark):
    df = spark.createDataFrame([(" ", "x", [" a ", "", "b"], "None"), (None, "y", [], "z")], "a string, b string, l array<string>, n string")
    value, key = columns.first_filled(df, ["a", "missing", "b"])
    out = df.select(value.alias("v"), key.alias("k"), columns.as_text(df, "l").alias("l"), columns.null_words(F.col("n")).alias("n"), columns.as_list(df, "n").alias("as")).collect()
    assert (out[0].v, out[0].k, out[0].n, out[0]["as"]) == ("x", "b", None, [])
    assert (out[1].l, out[1].n, out[1]["as"]) == (None, "z", ["z"])


def brute_chunks(sentences, matched, least=250):
    """Grow around each match in turn; one chunk per set of matched sentences."""
    out, seen = [], set()
    for at in (i for i, m in enumerate(matched) if m):
        order = [at] + [at + d for k in range(1, len(sentences)) for d in (k, -k)]
        parts, chars = [], 0
        for i in order:
            if 0 <= i < len(sentences) and chars < least:
                parts.append(i)
                chars += len(sentences[i])
        key = tuple(sorted(i for i in parts if matched[i]))
        if key not in seen:
            seen.add(key)
            out.append(". ".join(sentences[i] for i in parts))
    return out


def test_chunks_against_brute_force(spark):
    import random

    rng, rows, expected = random.Random(3), [], {}
    for doc in range(40):
        s = ["x" * rng.choice([0, 5, 60, 300]) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 14))]
        m = [rng.random() < 0.3 for _ in s]
        rows += [(doc, k + 1, t, int(f), ["k"] if f else None, ["w"] if f else []) for k, (t, f) in enumerate(zip(s, m, strict=True))]
        expected[doc] = brute_chunks(s, m)
    df = spark.createDataFrame(rows, "doc int, sentence_id int, sentence string, matched int, matched_keywords array<string>, matched_words array<string>")
    found: dict[int, list[str]] = {d: [] for d in expected}
    for r in chunks.context_chunks(df, "doc").orderBy("doc", "chunk_id").collect():
        found[r.doc].append(r.chunk)
    assert found == expected


def test_language_and_header(spark):
    row = spark.createDataFrame([("l", "a", "t")], "l string, a string, t string").select(keywords.with_header(F.col("l"), F.col("a"), F.array(F.lit("k")), F.lit("2020-01-01"), F.col("t")).alias("h")).first()
    assert re.match(r"---\nLink: l\nActor: a\nMatched keywords: k\nPublication date: 2020-01-01\n---\n\nt$", row.h)
