"""Pairs of chat files, data sets by name, literal lists and objects in files."""

from __future__ import annotations

from parlance.sources import files


def test_chat_pair(spark, tmp_path):
    (tmp_path / "posts.csv").write_text('id;text;tag\n1;"a; ""quoted""\nline";x\n2;plain;\n3;too;many;fields\n4;short\n5;;y\n6;empty more;z;\nseven;not a number;z\n')
    posts, none = files.read_chat(spark, str(tmp_path / "posts.csv"), None, "id long, text string, tag string", "id long")
    assert none is None
    want = [(1, 'a; "quoted"\nline', "x"), (2, "plain", None), (4, "short", None), (5, None, "y"), (None, "not a number", "z")]
    assert sorted(map(tuple, posts.collect()), key=str) == sorted(want, key=str)
    (tmp_path / "replies.csv").write_text("id;reply\n1;2\n1;3;4\n")
    found = files.read_chat(spark, str(tmp_path / "posts.csv"), str(tmp_path / "replies.csv"), "id long, text string, tag string", "id long, reply long")[1]
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    assert files.read_chat(spark, str(tmp_path / "posts.csv"), str(tmp_path / "missing.csv"), "id long, text string, tag string", "id long")[1] is None


def test_dataset_paths(spark, tmp_path):
    for name in ("dk/a/one_SPIDER.jl", "dk/b/two_SPIDER.jl", "se/c/three_YT.jl", "se/c/skip_SPIDER.jl", "se/c/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    names = lambda pattern, *gone: sorted(r.path.rsplit("/", 1)[1] for r in files.dataset_paths(spark, str(tmp_path), pattern, list(gone)).collect())
    assert names("*_SPIDER.jl") == ["one_SPIDER.jl", "skip_SPIDER.jl", "two_SPIDER.jl"]
    assert names("*_{SPIDER,YT}.jl", "skip_SPIDER.jl") == ["one_SPIDER.jl", "three_YT.jl", "two_SPIDER.jl"]
    assert all(r.modified is not None for r in files.dataset_paths(spark, str(tmp_path), "*.jl").collect())


def test_literal_lists():
    assert files.literal_list(" gay, women's safety ,, LGBTQ+,\ntransgender rights ") == ["gay", "women's safety", "LGBTQ+", "transgender rights"]
    assert files.literal_list("") == []


def test_objects_in_files(spark, tmp_path):
    path = str(tmp_path / "peaks")
    df = spark.createDataFrame([("dk", "a", '{"1": ["2020-01-01", "2020-01-31"]}'), ("dk", "b", '{}'), ("se", "a", '{"1": ["x", "y"], "2": ["z", "z"]}')], "country string, theme string, json string")
    files.write_objects(df, path, ["country", "theme"], "json")
    files.write_objects(df.filter("country = 'se'").selectExpr("country", "theme", "'{\"9\": [\"n\", \"m\"]}' as json"), path, ["country", "theme"], "json")
    got = sorted((r.country, r.theme, r.key, r.value) for r in files.read_objects(spark, path, "array<string>").collect())
    assert got == [("dk", "a", "1", ["2020-01-01", "2020-01-31"]), ("se", "a", "9", ["n", "m"])]
    assert len(list((tmp_path / "peaks/country=dk/theme=a").glob("part-*.txt"))) == 1
