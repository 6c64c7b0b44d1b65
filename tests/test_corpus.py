"""Standardisation, reduction, annotation, profiles, files and streams."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import annotation, profiling, reduce, standardize
from parlance.sources import files
from parlance.streaming import ingest


def brute_thread(posts, replies, root):
    """Depth first: archived replies by id, then posts that reply by id, each with its own."""
    text = {m: t for m, _, t in posts}
    out = [text[root]]

    def below(m):
        for _, _, t in sorted((r for r in replies if r[0] == m), key=lambda r: r[1]):
            out.append(t)
        for child in sorted(c for c, p, _ in posts if p == m):
            out.append(text[child])
            below(child)

    below(root)
    return out[0] if len(out) == 1 else out[0] + "\n--- \n\n\n" + "".join(t + " \n--- \n\n\n" for t in out[1:])


def test_threads_against_brute_force(spark):
    rng = random.Random(5)
    posts = [(m, rng.choice([None, 999, *[k for k in range(1, 40) if k < m]]), f"p{m}") for m in range(1, 40)]
    posts += [(50, 60, "child before parent"), (60, None, "late parent")]
    replies = [(rng.randrange(1, 40), 1000 + k, f"r{k}") for k in range(30)]
    known = {m for m, _, _ in posts}
    roots = [m for m, p, _ in posts if p not in known]
    out = standardize.threads(spark.createDataFrame(posts, "message_id long, parent_id long, text string"), spark.createDataFrame(replies, "parent_id long, reply_id long, text string")).collect()
    assert {r.root: r.thread_text for r in out} == {m: brute_thread(posts, replies, m) for m in roots}
    assert all((r.replies is None) == (r.thread_text.count("---") == 0) for r in out)
    assert sum(1 + len(r.replies or []) for r in out) == len(posts) + len(replies)


def test_forests_of_random_parents(spark):
    """Parents before and after their children, in three channels; replies that repeat, and those to nobody."""
    rng = random.Random(8)
    posts, replies = [], []
    for channel in "abc":
        order = list(range(60))
        rng.shuffle(order)
        posts += [(channel, m, order[rng.randrange(k)] if k and rng.random() < 0.9 else None, f"{channel}{m}") for k, m in enumerate(order)]
        replies += [(channel, rng.randrange(70), 100 + k // 2, f"r{channel}{k // 2}") for k in range(30)]
    df = spark.createDataFrame(posts, "channel string, message_id long, parent_id long, text string")
    out = standardize.threads(df, spark.createDataFrame(replies, "channel string, parent_id long, reply_id long, text string"), ["channel"]).collect()
    for channel in "abc":
        own, below = [p[1:] for p in posts if p[0] == channel], [r[1:] for r in replies if r[0] == channel]
        known = {m for m, _, _ in own}
        assert {r.root: r.thread_text for r in out if r.channel == channel} == {m: brute_thread(own, [r for r in below if r[0] in known], m) for m, p, _ in own if p is None}


def test_chains_of_five_thousand_posts(spark):
    for child in (1, -1):  # every post is written after, before its parent
        posts = [(k * child, (k - 1) * child if k else None, f"t{k}") for k in range(5000)]
        row = standardize.threads(spark.createDataFrame(posts, "message_id long, parent_id long, text string")).collect()
        assert len(row) == 1 and row[0].root == 0 and [r.text for r in row[0].replies] == [f"t{k}" for k in range(1, 5000)]


def test_places_of_a_wide_tree_hold_no_paths(spark):
    nodes = spark.range(2000).select(F.col("id").alias("message_id"))
    parents = nodes.filter("message_id > 0").select("message_id", F.expr("(message_id - 1) div 40").alias("parent_id"))
    places = standardize.preorder(parents, nodes, [])
    assert [kind for _, kind in places.dtypes] == ["bigint"] * 3
    got = [r.message_id for r in places.orderBy(F.desc("left")).collect()]

    def below(m):
        return [m, *[x for c in range(40 * m + 1, min(40 * m + 41, 2000)) for x in below(c)]]

    assert got == below(0)


def test_repeated_and_nameless_posts(spark):
    rows = [(1, None, "b"), (1, None, "a"), (2, 1, "x"), (2, 1, "x"), (None, 1, "lost"), (3, None, None)]
    out = {r.root: r.thread_text for r in standardize.threads(spark.createDataFrame(rows, "message_id long, parent_id long, text string")).collect()}
    assert out == {1: "a\n--- \n\n\nx \n--- \n\n\n", 3: ""}
    assert standardize.threads(spark.createDataFrame([], "message_id long, parent_id long, text string")).count() == 0


def test_web_rows(spark):
    df = spark.createDataFrame(
        [(["Big ", "", "news"], "Sub", " Text", [" A ", "None"], "None", ["u"], [], ["c"], ["t", "c"], [" ref ", ""])],
        "article_title array<string>, article_sub_title string, article_text string, author array<string>, publication_date string, external_links array<string>, youtube_links array<string>, categories array<string>, themes_text array<string>, references_text array<string>",
    )
    row = standardize.web(df).first()
    assert row.asDict().keys() == set(standardize.WEB_COLUMNS)
    assert (row.article_title, row.article_text, row.publication_date, row.links_in_text, row.embedded_media_links) == ("Big\nnews", "Sub\n Text", None, ["u"], None)
    assert row.article_categories == ["c", "t", "c"] and row.other_items == {"references_text": ["ref"]} and row.scrape_date is None


def test_videos_need_their_columns(spark):
    with pytest.raises(ValueError, match="video_id"):
        standardize.videos(spark.createDataFrame([("x",)], "source string"))


def test_forum_blocks(spark):
    text = "\n---\nPOST: \nAuthor: Ann van Dyk\nDate: 2024-01-02\nTag: p1\n---\nfirst --- body\n---\nstill it\n\n\n---\nCOMMENT:\nAuthor: Bo\nDate:  Idag 10:00\nTag: \n---\n second\nline\n \n\n---\nPOST:\nAuthor:\nDate: x\nTag: t\n---\nthird"
    plain = "He wrote --- POST: x --- and left"
    rows = spark.createDataFrame([(1, text, "2024-05-01", None), (2, plain, "2024-05-01", "Idag"), (3, text, "no day", "Igår"), (4, None, None, None)], "k int, thread_text string, scrape_date string, publication_date string")
    out = standardize.forum(rows).orderBy("k").collect()
    assert [(r.label, r.author, r.date, r.tag, r.text) for r in out[0].replies] == [("POST", "Ann van Dyk", "2024-01-02", "p1", "first --- body\n---\nstill it"), ("COMMENT_1", "Bo", "2024-05-01 10:00", "", "second\nline"), ("POST", "", "x", "t", "third")]
    assert out[0].thread_text == "first --- body\n---\nstill it\n---\n\nsecond\nline\n---\n\nthird"
    assert (out[0].publication_date, out[0].post_author) == ("2024-01-02", "Ann van Dyk")
    assert (out[1].replies, out[1].thread_text, out[1].publication_date, out[1].post_author) == (None, plain, "Idag", None)
    assert (out[2].publication_date, out[2].replies[1].date) == ("Igår", "Idag 10:00") and out[3].replies is None


def test_bodies_of_threads(spark):
    known = {
        "Post_id: 1\nPost_text: one\ntwo \n---\nComment_id: 2\nComment_text:\tthree\n---\nComment_text: \n---\nComment_text: no end": "one\ntwo\n\nthree",
        "Post_text: a\n---\nPost_text: b\n---": "a",
        "Post_text: never ends": "Post_text: never ends",
        "POST: head\n\n\n---\nCOMMENT:\nAuthor: a b\n---\nbody\n\n\n---\nx\n---\nmore": "POST: head\nbody\nmore",
        "\n\n\n---\nPOST: x\n---\n": "\n\n\n---\nPOST: x\n---\n",
        r"Post_text: one\n---\nComment_text: two\n---": "one\n\ntwo",
        "He said --- and this is all important --- then left.": "He said --- and this is all important --- then left.",
        "COMMENT: --- a --- b": "COMMENT: --- a --- b",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(known)], "k int, t string")
    assert [r.x for r in df.select("k", reduce.without_blocks(F.col("t")).alias("x")).orderBy("k").collect()] == list(known.values())


def test_author_words(spark):
    df = spark.createDataFrame([(k, a) for k, a in enumerate([[" No Author "], ["none"], ["NULL"], ["nothing else"], ["Ann ", "", "Bo"], []])], "k int, author array<string>")
    out = standardize.web(df, keep=("k",)).orderBy("k").collect()
    assert [r.author or None for r in out] == [None, None, None, "nothing else", "Ann, Bo", None]


def test_sentinels_count_chunks(spark):
    rows = [(k, "f1", "no text" if k in (1, 6) else f"a long text number {k}", None) for k in range(9)]
    rows += [(20, "f1", "once", None), (21, "f1", "once", None), (30, "f2", " no text", None), (31, "f2", "no", " text"), (32, None, "no text", "")]
    df = spark.createDataFrame(rows, "n int, file string, a string, b string")
    found = lambda **k: {(r.value, r.chunks) for r in profiling.sentinels(df, ["a", "b"], "file", ["n"], **k).collect()}
    assert found(rows=5) == {("no text", 4), ("once", 2)} and found() == {("no text", 3)} and found(rows=1, most=4) == {("once", 2)}


def test_entry_ids(spark):
    df = spark.createDataFrame([(1, "A b.c", "Website"), (2, "abc", "Website"), (3, "!", "YouTube"), (4, None, "YouTube"), (5, "abc", None)], "n int, actor string, platform string")
    assert [r.entry_ID for r in standardize.entry_ids(df, "DK", ["n"]).orderBy("n").collect()] == ["DK-ABC-W-1", "DK-ABC-W-2", "DK-XXX-Y-1", "DK-UNKNOWN-Y-1", "DK-ABC-UNKNOWN-1"]


def test_reduced(spark):
    df = spark.createDataFrame([("1", "a", "Website", "T", "x"), ("2", "a", "Website", None, "y"), ("3", "a", "Flashback", "T", "z"), ("4", "a", "Website", None, "nan"), ("5", "a", None, "only", "")], "entry_ID string, actor string, platform string, article_title string, article_text string")
    out = reduce.reduced(df).orderBy("entry_ID").collect()
    assert [(r.entry_ID, r.text) for r in out] == [("1", "T\n\nx"), ("2", "y"), ("5", "only")] and list(out[0].asDict()) == reduce.REDUCED


def test_annotation(spark):
    df = spark.createDataFrame([(1, "hello world", [(7, "x", 0, 5)]), (2, "none", [])], "id int, text string, entities array<struct<id:bigint,label:string,start_offset:int,end_offset:int>>")
    assert [(r.id, r.span) for r in annotation.flattened(df).collect()] == [(1, "hello")]
    new = spark.createDataFrame([(1, ">> hello world"), (3, "other")], "id int, text string")
    moved = {r.id: r.entities for r in annotation.transferred(new, df, "id", {"x": "y"}).collect()}
    assert moved[3] == [] and (moved[1][0].label, moved[1][0].start_offset, moved[1][0].end_offset) == ("y", 3, 8)
    raw = spark.createDataFrame([("src", "the thing, here", "2020-01-05"), ("thing", "a thing x", "2020-01-05")], "source string, article_text string, publication_date string")
    out = annotation.prepared(raw, ["thing"], start="2020-01-01", end="2020-02-01").collect()
    assert len(out) == 1 and out[0].text.startswith("---\nLink: \nActor: src\nMatched keywords: thing\n")
    assert annotation.prepared(raw, ["absent"]).columns == annotation.prepared(raw, ["thing"]).columns


def test_profiles(spark):
    lines = [{"a": 1, "b": "x", "c": []}, {"a": None, "b": [1], "c": {"d": 1}}, {"a": 1.5, "b": True}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("[1]",), ("broken",)], "value string")
    found = {(r.key, r.type): r.n for r in profiling.type_profile(profiling.json_types(df, "value")).collect()}
    assert found == {("a", "int"): 1, ("a", "NA"): 1, ("a", "float"): 1, ("b", "str"): 1, ("b", "list"): 1, ("b", "bool"): 1, ("c", "EmptyList"): 1, ("c", "dict"): 1}
    profile = profiling.type_profile(profiling.json_types(df, "value"))
    wrong, unexpected, missing = profiling.type_deviations(profile, spark.createDataFrame([("a", ["int", "NA"]), ("z", ["str"])], "key string, types array<string>"))
    assert [(r.key, r.type) for r in wrong.collect()] == [("a", "float")] and sorted(r.key for r in unexpected.collect()) == ["b", "c"] and [r.key for r in missing.collect()] == ["z"]
    rows = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", None), (None, "q", "r"), (3, "y", "s")], "id int, a string, b string")
    assert sorted((r.id, r.group_size) for r in profiling.duplicate_rows(rows, "id").collect()) == [(1, 2), (2, 2)]
    assert sorted((str(r.id), r.problem) for r in profiling.key_problems(rows, "id").collect()) == [("3", "duplicate"), ("None", "missing")]
    with pytest.raises(ValueError):
        profiling.pseudonymised(rows, spark.createDataFrame([("x", "I1", "TRUE "), ("x", "I2", "true")], "actor string, identifier string, is_influencer string"), "a")


def test_files(spark, tmp_path):
    (tmp_path / "a.jl").write_text('{"x": 1}\nbroken\n{"x": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jl"), "x int", "skip").count() == 2
    assert files.count_valid(spark, str(tmp_path / "a.jl")) == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        files.read_jsonl(spark, str(tmp_path / "a.jl"), "x int").collect()
    (tmp_path / "d.txt").write_text('{"lgb": [" Gay ", ""], "woke": ["woke*"]}')
    assert sorted(tuple(r) for r in files.dictionary(spark, str(tmp_path / "d.txt")).collect()) == [("lgb", "gay"), ("woke", "woke*")]
    paths = ["r/dk/websites/x/a_SPIDER_2024_01_02.jl", "r/dk/websites/x/a_SPIDER_2024_03_01.jl", "r/dk/websites/x/a_SPIDER.jl", "r/dk/flashback/y/b_SPIDER.jl", "r/dk/q/z/c_YT.jl", "r/dk/q/z/d.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.p for r in df.select(files.platform_of(F.col("path")).alias("p")).collect()] == ["Website", "Website", "Website", "Flashback", "YouTube", None]
    assert sorted(r.path for r in files.latest_snapshots(df).collect()) == sorted(paths[1:2] + paths[3:])
    good, failed = files.read_all({"ok": lambda: df, "bad": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert list(good) == ["ok"] and failed[0][0] == "bad"
    rows = spark.createDataFrame([("Act or", dt.date(2024, 3, 1), "t1"), ("B", None, "t2")], "actor string, day date, text string")
    files.dump_by_month(rows, str(tmp_path / "dump"), "actor", "day", "text")
    assert (tmp_path / "dump/actor=Act_or/year=2024/month=03").is_dir() and (tmp_path / "dump/actor=B/year=no_date/month=no_date").is_dir()
    files.write(rows, str(tmp_path / "out"), "parquet", ["actor"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    landing, target = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.json").write_text('{"t": "x thing"}\n{"t": "y"}\n')
    run = lambda: ingest.ingest(spark, str(landing), "t string", lambda d: d.filter(F.col("t").contains("thing")), target, str(tmp_path / "cp")).awaitTermination(120)
    run()
    (landing / "b.json").write_text('{"t": "thing two"}\n')
    run()
    assert sorted(r.t for r in spark.read.parquet(target).collect()) == ["thing two", "x thing"]
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h % 24), "a" if h % 3 else "b") for h in range(40)], "ts timestamp, actor string")
    rows.write.parquet(str(tmp_path / "ev"))
    stream = ingest.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), "ts", "actor")
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, ingest.windowed_counts(rows, "ts", "actor").collect()))
