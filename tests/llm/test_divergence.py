"""The divergence audit against counts in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(LOWER))


def expected(rows, least=10, top=10):
    """Rows of (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = terms(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        value = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            parts = {
                "pair": [(sum(value(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(value(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


LONG = ["x" * 17, "x" * 17 + "y", "a" * 16, "a" * 15, "é" * 8, "é" * 9, "漢字" * 30, "abcdefgh", "abcdefghi", "ABCDEFGH", "Éé", "b" * 300]


def rows_of(n: int) -> list[tuple]:
    draw = random.Random(11)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + LONG
    gaps = [" ", "\n", "1", "_", "\x00", "-", "[", "\x7f", ". "]
    out = []
    for k in range(n):
        text = "".join(draw.choice(words[: 10 + k % 60]) + draw.choice(gaps) for _ in range(draw.randrange(40)))
        out.append((draw.choice(["en", "en", "en", "de", None, ""]), draw.choice(["hot", "hot", "s1", "S1", "é", None, ""]), draw.choice([text, text, text, None, ""])))
    # a group without kept terms, a language without any, one of a single source, repeated rows
    return [*out, *out[:20], ("en", "numbers", "1 2 3"), ("fr", "a", "un"), ("fr", "b", None), ("it", "alone", "uno due")]


@pytest.fixture(scope="module")
def rows():
    return rows_of(400)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


@pytest.mark.parametrize(("size", "block"), [(divergence.SLAB, (256, 512)), (70, (2, 5)), (1, (1, 1))])
def test_audit_equals_plain_counts(spark, rows, size, block):
    assert found(divergence.audit(frame(spark, rows).repartition(6), size=size, block=block)) == expected(rows)


def test_thresholds(spark, rows):
    assert found(divergence.audit(frame(spark, rows), least=40, top=2)) == expected(rows, 40, 2)


def test_empty_table_and_texts_without_terms(spark):
    assert found(divergence.audit(frame(spark, []))) == []
    bare = [("en", s, "1 2 3") for s in "abc"]
    got = found(divergence.audit(frame(spark, bare)))
    assert got == expected(bare) and {r[4] for r in got} == {0} and len(got) == 6


def test_columns_named_like_inner_ones(spark, rows):
    inner = "term string, n long, docs long, i long, p long, q long, tree string, size long, kept long, item string, value long, rank int"
    df = spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5, "x", 6, 7, "y", 8, 9) for r in rows[:80]], f"lang string, source string, text string, {inner}")
    assert found(divergence.audit(df)) == expected(rows[:80])


def test_one_long_text_in_pieces(spark):
    words = [f"{chr(97 + k % 26) * (1 + k % 40)}" for k in range(30_000)]
    data = np.frombuffer((" ".join(words) + " " + "é" * 5000).encode(), np.uint8)
    want = Counter(terms(bytes(data).decode()))
    for size in (100, 5000, 1 << 20):
        got = divergence.long_text(data, 3, size).to_pylist()
        assert {r["term"]: r["n"] for r in got} == want and {(r["g"], r["docs"]) for r in got} == {(3, 1)} and len(got) == len(want)


def test_radix_order_is_stable():
    draw = np.random.default_rng(5)
    keys = [draw.integers(0, 3, 5000).astype(np.uint64) << np.uint64(50), draw.integers(0, 2**63, 5000).astype(np.uint64) >> np.uint64(60), draw.integers(0, 4, 5000).astype(np.uint32)]
    assert (divergence.radix_order(keys) == np.lexsort(keys[::-1])).all()


def test_shares_of_very_large_counts_are_exact(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 10**7), (0, 10**15, 3), (2**40, 2**45, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, s long, v long").select(divergence.share("n", "s", "v")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (s + 2 * v) for n, s, v in rows]


def test_no_stage_pairs_the_sources_of_a_term(spark):
    """One term in every one of 300 sources: what is dealt for the pairs grows with sources and terms, not with pairs."""
    rows = [("en", f"s{k}", "common " * (1 + k % 5) + "other") for k in range(300)]
    texts = frame(spark, rows)
    counts = divergence.term_counts(texts)
    assert counts.count() == 600 and counts.agg(F.sum("docs")).first()[0] == 600
    got = found(divergence.audit(texts, block=(100, 512)))
    assert got == expected(rows) and sum(r[2] == "pair" for r in got) == 300 * 299
