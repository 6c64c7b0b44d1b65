"""The index of patterns against running every pattern."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from parlance.functions import patterns
from parlance.functions.patterns import PatternIndex, anchor
from parlance.operators import keywords

ODD = ["İstanbul", "ISTANBUL", "istanbul", "ıslak", "ſtop", "STOP", "Kelvin", "kelvin", "ΣΑΣ", "σας", "σασ", "Straße", "STRASSE", "ǅ", "ǆ", "éte", "école", "ÉCOLE", "𐐀𐐁𐐂𐐃", "𐐨𐐩𐐪𐐫", "naïve", "co-op", "c++", "#tag", "x_y", "a.b", "日本語", "Ⓐlpha", "عربي", "हिन्दी", "a‍b"]


def words_of(draw, n):
    return ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 8))) for _ in range(n)]


def dictionary_of(draw, n):
    out = []
    for w in words_of(draw, n) + ODD * 3:
        form = draw.choice(["{0}", "{0}*", "*{0}", "*{0}*", "{0} {1}", "{0}*{1}", "*{0} {1}*", " {0} ", "{0}-{1}", "{0}.", "#{0}"])
        out.append(form.format(w, draw.choice(words_of(draw, 1))))
    return [*out, "*", "**", "$$", "*$*", "-"]


def both_ways(monkeypatch, f):
    out = []
    for few in (10**9, -1):
        monkeypatch.setattr(patterns, "FEW", few)
        out.append(f())
    return out


def texts_of(draw, n):
    gap = [" ", ",", ".", "-", "\n", "  ", "+", "*", "", " "]
    return ["".join(x for w in draw.choices(words_of(draw, 30) + ODD, k=draw.randrange(14)) for x in (w, draw.choice(gap))) for _ in range(n)] + ["", None]


def test_matches_are_those_of_every_pattern(spark, monkeypatch):
    draw = random.Random(4)
    rows = list(enumerate(texts_of(draw, 500)))
    df = spark.createDataFrame(rows, "id int, sentence string").repartition(4)
    wrong = ["", " ABC ", *words_of(draw, 40)]
    for k in range(3):
        words = dictionary_of(draw, 150)
        for edges in ("sentence", "space"):
            f = (lambda words=words: keywords.match(df, words, wrong)) if edges == "sentence" else (lambda words=words: keywords.annotation_match(df, words, "sentence"))
            plain, indexed = both_ways(monkeypatch, lambda f=f: sorted(f().collect(), key=str))
            assert plain == indexed and len(plain) > 100, k
            assert sum(r.matched_keywords is not None for r in plain) > 100


def test_routed_dictionaries_with_indexes(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(k, "xyz"[k % 3], t) for k, t in enumerate(texts_of(draw, 200))]
    df = spark.createDataFrame(rows, "id int, theme string, sentence string")
    dictionaries = {"x": (dictionary_of(draw, 40), ["a"]), "y": (["a*", "*b"], [])}
    plain, indexed = both_ways(monkeypatch, lambda: sorted(keywords.match_routed(df, dictionaries, F.col("theme")).collect(), key=str))
    assert plain == indexed and all(r.matched == 0 for r in plain if r.theme == "z")


def test_anchors():
    known = {"thing*": ("p4", "thin"), "*tion": ("s4", "tion"), "Er": ("e", "er"), "*x*": ("i1", "x"), "*abcd*": ("i3", "abc"), "a bcd": ("e", "bcd"), "ab*cdef": ("s4", "cdef"), "*ab cd*": ("s2", "ab"), "*": None, "$$": None, "": None}
    assert {k: anchor(k) for k in known} == known
    assert anchor("a*bcd", "space") == ("e", "bcd")  # a star inside is a character there


def test_an_index_over_its_bound_is_an_error(monkeypatch):
    monkeypatch.setattr(patterns, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="split the dictionary"):
        PatternIndex([f"word{k}" for k in range(100)])


def test_time_hardly_grows_with_the_dictionary(spark):
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(draw.choice(letters) for _ in range(7))
    texts = [(k, " ".join(word() for _ in range(15))) for k in range(4000)]
    df = spark.createDataFrame(texts, "id int, sentence string").repartition(4).cache()
    df.count()

    def took(n: int) -> float:
        words = [draw.choice(["{0}", "{0}*", "*{0}", "*{0}*"]).format(word()) for _ in range(n)]
        times = []
        for _ in range(3):
            began = time.perf_counter()
            keywords.match(df, words).agg(F.sum("matched")).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    took(20)
    assert took(4000) < 4 * took(40) + 1
    df.unpersist()


def test_keywords_of_one_word_need_no_pattern(spark):
    """All words of a dictionary but those of several words, inner stars or both stars are looked up; letters that fold stay letters."""
    assert [patterns.plain(k) for k in ("Ab", "ab*", "*aB", " x ", "*ab*", "a*b", "a b", "a-b", "*", "")] == [("e", "ab"), ("p", "ab"), ("s", "ab"), ("e", "x"), None, None, None, None, None, None]
    assert "rlike" not in (found := keywords._found([f"word{k}" for k in range(40)], [], "t")) and "(?iU)" not in found
    upper, lower = patterns._case()
    row = spark.createDataFrame([(upper, lower)], "a string, b string").selectExpr(r"regexp_extract_all(a, '(?U)\\w', 0) as a", r"regexp_extract_all(b, '(?U)\\w', 0) as b").first()
    assert len(row.a) > 1000 and [patterns.fold(c) for c in row.a] == row.b
