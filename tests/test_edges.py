"""Circles of replies, dates of many kinds, lines that don't parse, long texts."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from parlance.functions.dates import parsed_date, writes_day_first
from parlance.operators import chunks, keywords, profiling, sampling, standardize, terms
from parlance.sources import files


def threads_of(spark, rows):
    df = spark.createDataFrame(rows, "message_id long, parent_id long, text string")
    return {r.root: [x.message_id for x in r.replies or []] for r in standardize.threads(df).collect()}


def reference(rows):
    """Each post without a known parent with all that is below it. The least of a circle has no parent."""
    parent = {m: p for m, p, _ in rows if p != m and p in {r[0] for r in rows}}
    for m in sorted(parent):
        seen, at = [m], parent.get(m)
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        if at is not None:
            parent.pop(min(seen[seen.index(at) :]), None)
    below = lambda m: [x for c in sorted(k for k, p in parent.items() if p == m) for x in [c, *below(c)]]
    return {r[0]: below(r[0]) for r in rows if r[0] not in parent}


def test_threads_end_on_circles(spark):
    for links in (
        [(1, 2), (2, 1), (3, None)],
        [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4), (6, 6)],
        [(5, 9), (9, 5), (1, 5), (2, 1), (7, 77)],
        [(1, 2), (2, 3), (3, 4), (4, None), (5, 4)],
        [(4, None), (2, 4), (3, 2), (6, 3), (1, 6)],
    ):
        rows = [(m, p, f"t{m}") for m, p in links]
        assert threads_of(spark, rows) == reference(rows), links


def test_forum_rows_in_new_form_keep_their_replies(spark):
    kind = "array<struct<label:string,author:string,date:string,tag:string,text:string>>"
    rows = [("2024-05-02", "own text", [("POST", "ann", "Igår", "", "own text")], None, "Idag 09:00"), ("2024-05-02", "---\nPOST:\nAuthor: bob\nDate: Igår 10:00\nTag: t\n---\nhello", None, " ", None), ("2024-05-02", "plain", [], None, None)]
    out = standardize.forum(spark.createDataFrame(rows, f"scrape_date string, thread_text string, replies {kind}, post_author string, publication_date string")).collect()
    assert [(r.thread_text, len(r.replies or []), r.post_author, r.publication_date) for r in out] == [("own text", 1, None, "2024-05-02 09:00"), ("hello", 1, "bob", "2024-05-01 10:00"), ("plain", 0, None, None)]
    assert out[0].replies[0].date == "2024-05-01"


def test_dates(spark):
    known = {
        "2024-03-05T10:00:00.123Z": "2024-03-05", "2024-03-05T23:30:00+0200": "2024-03-05", "Tue, 05 Mar 2024 10:00:00 GMT": "2024-03-05", "5 Mar 2024 10:00:00 +0000": "2024-03-05", "05/03/2024 10:11:12": "2024-05-03", "25/03/2024 10:11:12": "2024-03-25",
        "3 mai 2024": "2024-05-03", "12. juni 2024": "2024-06-12", "3 de marzo de 2024": "2024-03-03", "2024. május 3.": "2024-05-03", "1er août 2024": "2024-08-01", "3 foo 2024": None, "soon": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in known] + [(None,)], "t string")
    assert {r.t: r.d and str(r.d) for r in df.withColumn("d", parsed_date(F.col("t"))).collect()} == known | {None: None}
    pairs = spark.createDataFrame([("a", "x", "05/03/2024"), ("b", "x", "05/03/2024"), (None, "x", "05/03/2024")], "actor string, platform string, t string")
    out = pairs.withColumn("d", parsed_date(F.col("t"), writes_day_first(F.col("actor"), F.col("platform"), [("a", "x")]))).collect()
    assert [str(r.d) for r in out] == ["2024-03-05", "2024-05-03", "2024-05-03"]


def test_lines_that_do_not_parse_are_logged(spark, tmp_path):
    (tmp_path / "a.jl").write_text('{"id": 1, "t": "x"}\n{"id": oops\n\n[1]\n{"id": 2}\n')
    (tmp_path / "b.jl").write_text('{"id": 3, "t": "y", "more": 1}\n')
    from pyspark.sql import types as T

    rows, failed = files.read_logged(spark, {"a": str(tmp_path / "a.jl"), "b": str(tmp_path / "b.jl")}, T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())]))
    assert sorted((r.source_name, r.id, r.t or "") for r in rows.collect()) == [("a", 1, "x"), ("a", 2, ""), ("b", 3, "y")]
    assert [(r.source_name, r.n_lines) for r in failed.collect()] == [("a", 2)]


def test_routes_in_one_pass(spark):
    df = spark.createDataFrame([(1, "en", "A thing here"), (2, "de", "nicht thing"), (3, "fr", "thing"), (4, None, "thing")], "id int, lang string, sentence string")
    out = keywords.match_routed(df, {"en": (["thing*"], []), "de": (["nicht"], [])}, F.col("lang"))
    assert {r.id: r.matched_keywords for r in out.collect()} == {1: ["thing*"], 2: ["nicht"], 3: None, 4: None}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_chunks_of_a_long_text(spark):
    rows = [("a", k + 1, "word " * (k % 7) if k % 11 else "", int(k % 2 == 0), ["w"] if k % 2 == 0 else None, ["w"] if k % 2 == 0 else None, f"s{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "entry_ID string, sentence_id int, sentence string, matched int, matched_keywords array<string>, matched_words array<string>, source string")
    began = time.perf_counter()
    out = {r.anchor_id: r for r in chunks.context_chunks(df, carry=["source"]).collect()}
    assert time.perf_counter() - began < 60
    for at in (0, 2, 1500, 2998):
        parts, chars = [at], len(rows[at][2])
        for k in range(1, 6000):
            i = at + (k + 1) // 2 if k % 2 else at - k // 2
            if 0 <= i < 3000:
                if chars >= 250:
                    break
                parts.append(i)
                chars += len(rows[i][2])
        if at + 1 in out:
            assert out[at + 1].chunk == ". ".join(rows[i][2] for i in parts) and out[at + 1].source == f"s{at}"
    assert len(out) > 1400


def test_pieces_of_a_long_text(spark):
    text = ("word " * 500 + "\n") * 400
    began = time.perf_counter()
    out = terms.pieces(spark.createDataFrame([(1, text), (2, "x" * 20_001), (3, None)], "id long, text string"), "id").collect()
    assert time.perf_counter() - began < 30 and all(0 < len(r.piece) <= 8000 for r in out)
    assert "".join(r.piece for r in out if r.id == 1).replace(" ", "").replace("\n", "") == "word" * 200_000 and [len(r.piece) for r in out if r.id == 2] == [8000, 8000, 4001]


def cut(text, most, least):
    text, start, out = (text or "").strip(), 0, []
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            place = text.rfind("\n", start, end)
            if place == -1:
                place = text.rfind(" ", start, end)
            if place > start + least:
                end = place
        if text[start:end].strip():
            out.append(text[start:end].strip())
        start = end
    return out


def test_pieces_of_all_kinds(spark):
    draw = random.Random(1)
    rows = [(k, "".join(draw.choice(["word", " ", " ", "\n" if k % 3 else " ", "x" * draw.randrange(40)]) for _ in range(draw.randrange(300)))) for k in range(60)]
    rows += [(100, None), (101, "   "), (102, "a" * 100), (103, "\n" + "b" * 250), (104, ("c" * 19 + "\n") + "d " * 200), (105, " é漢" * 300)]
    df = spark.createDataFrame(rows, "id long, text string")
    for most, least in ((100, 20), (50, 0), (37, 36)):
        found = {}
        for r in terms.pieces(df, "id", most=most, least=least).orderBy("id", "piece_id").collect():
            found.setdefault(r.id, []).append((r.piece_id, r.piece))
        assert found == {k: list(enumerate(cut(t, most, least), 1)) for k, t in rows if cut(t, most, least)}


def test_excerpts(spark):
    rows = [(": - text", None), ("Title: - the  text", " Title "), ("Title only", "Title only"), (" - x", ""), (None, "t"), ("other", "Title"), ("a" * 400, "b")]
    df = spark.createDataFrame(rows, "text string, title string")
    assert [r.x for r in df.select(sampling.excerpt(F.col("text"), F.col("title")).alias("x")).collect()] == [": - text", "the text", "", "- x", "", "other", "a" * 300]


def test_profiles_can_be_lazy_together(spark):
    one = profiling.json_types(spark.createDataFrame([('{"a": 1}',)], "j string"), "j")
    two = profiling.json_types(spark.createDataFrame([('{"b": "x"}',), ("[1]",), (None,)], "j string"), "j")
    assert [tuple(r) for r in one.union(two).collect()] == [("a", "int"), ("b", "str")]


def test_rows_for_annotators_without_a_source(spark):
    rows = [(None, "l1", "t", "2024-01-01", "see the end"), ("the", "l2", "t", "2024-01-01", "see the end"), ("x", "l3", "t", "2024-01-01", "Post_text: nothing --- see the end")]
    df = spark.createDataFrame(rows, "source string, url string, article_title string, publication_date string, text string")
    from parlance.operators import annotation

    assert {r.link for r in annotation.prepared(df, ["the"]).collect()} == {"l1", "l3"}
    assert {r.link for r in annotation.prepared(df, ["the"], chats=True).collect()} == {"l1"}


def test_density_clusters_of_equal_and_missing_points(spark):
    from parlance.operators import vectors

    rows = [(k, [float(k % 3) * 5, 0.0]) for k in range(40)] + [(99, [50.0, 50.0]), (100, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    out = {r.id: r.cluster for r in vectors.density_clusters(df, "id", epsilon=1.0).collect()}
    assert out == {k: k % 3 for k in range(40)} | {99: -1}
    assert vectors.density_clusters(df.limit(0), "id").count() == 0


def test_running_numbers_over_many_parts(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 > 0 then 'hot' else concat('c', id % 50) end as code")
    out = standardize.running_number(df, "code", ["id"]).collect()
    seen: dict = {}
    for r in sorted(out, key=lambda r: r.id):
        seen[r.code] = seen.get(r.code, 0) + 1
        assert r["__number"] == seen[r.code]
