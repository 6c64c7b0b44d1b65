"""I-Match fingerprints against the definition in plain Python integers."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import imatch
from parlance.llm.textnum import word_prints
from tests.llm.test_divergence import terms

MASK = (1 << 64) - 1


def mixed(x: int) -> int:
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def printed(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int(word_prints(data, np.array([0]), np.array([len(data)]))[0])


def sketch(text: str, band: set[str]) -> tuple[int, list[list[int]]] | str:
    own = sorted(printed(t) for t in set(terms(text)) & band)
    if not own:
        return hashlib.sha256(text.encode()).hexdigest()
    base = max(len(own).bit_length() - 2, 0)
    levels = []
    for level in range(base, base + imatch.LEVELS):
        hashes = []
        for k in range(1, imatch.PARTS + 1):
            seed = mixed(k * 0x9E3779B97F4A7C15 & MASK)
            left = [p for p in own if mixed(p ^ seed) % 2**level == 0]
            total = sum(mixed(p) * pow(int(imatch.STEP), i, 1 << 64) for i, p in enumerate(left)) & MASK
            hashes.append(max(mixed(total) >> 48, 1) if left else 0)
        levels.append(hashes)
    return base, levels


def written(x) -> str:
    if isinstance(x, str):
        return f"{imatch.WHOLE:02x}{x}".ljust(2 + 4 * imatch.LEVELS * imatch.PARTS, "0")
    return f"{x[0]:02x}" + "".join(f"{h:04x}" for level in x[1] for h in level)


def alike(x, y) -> float:
    if isinstance(x, str) or isinstance(y, str):
        return float(x == y)
    for level in range(min(x[0], y[0]) + imatch.LEVELS - 1, max(x[0], y[0]) - 1, -1):
        pairs = [(a, b) for a, b in zip(x[1][level - x[0]], y[1][level - y[0]], strict=True) if a or b]
        if 2 * len(pairs) >= imatch.PARTS or level == max(x[0], y[0]):
            return sum(a == b for a, b in pairs) / max(len(pairs), 1)
    return 0.0


def expected(rows):
    """Rows of different (id, text), ids different but for equal texts."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    docs = Counter(t for _, text in rows for t in set(terms(text)))
    band = {t for t, n in docs.items() if n * 2**imatch.RARE >= len(rows) and n * 2**imatch.COMMON <= max(len(rows), 2**imatch.COMMON)}
    out = []
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        x, y, z = (sketch(t, band) for t in (text, new, after))
        out.append((k, len(text), hashlib.sha256(new.encode()).hexdigest(), written(x), written(y), round(alike(x, y), 9), round(alike(x, z), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def rows_of(n: int) -> list[tuple]:
    draw = random.Random(23)
    words = [f"t{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'é' * (k % 3)}" for k in range(600)]
    out = []
    for k in range(n):
        size = draw.choice([0, 1, 2, 5, 40, 200, 400])
        out.append((k * 3, " ".join(["the", *draw.choices(words, k=size)]) if size else draw.choice([None, "", "漢", "the 12", "42"])))
    out += [(10_000 + k, out[7][1]) for k in range(3)]  # copies
    return [*out, (10_003, out[6][1] + " more"), (None, "no id at all")]


@pytest.mark.parametrize("parts", [1, 7])
def test_every_row_equals_the_definition(spark, parts):
    rows = rows_of(120)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if parts > 1 else "true")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert found(imatch.compare(df)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_single_rows_empty_tables_and_equal_ids(spark):
    for text in ("one text of some words", "", None, "7"):
        rows = [(5, text)]
        assert found(imatch.compare(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
    assert imatch.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = [(1, "alpha beta gamma")] * 40 + [(None, None)] * 3
    df = spark.createDataFrame(same, "doc_id long, text string").repartition(5)
    got = found(imatch.compare(df))
    assert len(got) == 43 and {r[3] for r in got if r[0] == 1} == {got[0][3]} and found(imatch.compare(df)) == got


def test_copies_are_near_and_others_are_not(spark):
    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnprst"]
    rows = []
    for k in range(0, 400, 2):
        text = draw.choices(words, k=300)
        rows += [(k, " ".join(text)), (k + 1, " ".join([*text[:140], "changed", *text[141:]]))]
    rows += [(1000 + k, " ".join(f"{chr(97 + k % 26)}{chr(97 + j % 26)}x{chr(97 + j // 26)}{chr(97 + k // 26)}" for j in range(120))) for k in range(60)]
    near = {r.doc_id: (r.near_edited, r.near_next) for r in imatch.compare(spark.createDataFrame(rows, "doc_id long, text string"), common=0).collect()}
    copies = [near[k][1] for k in range(0, 400, 2)]
    assert sum(x > 0.8 for x in copies) > 190
    others = [near[1000 + k] for k in range(59)]
    assert max(x[1] for x in others) < 0.1 and sum(x[0] for x in others) / len(others) > 0.15


def test_long_texts_go_in_pieces():
    draw = random.Random(2)
    text = " ".join(draw.choice(["alpha", "Beta", "é" * 30, f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}"]) for k in range(20_000))
    texts = pa.array(["short text", text, None, "x" * 3000, "end"]).fill_null("")
    want = [(i, p) for i, t in enumerate(texts.to_pylist()) for p in sorted(printed(x) for x in set(terms(t)))]
    band = np.sort(np.array([printed("alpha"), printed("wab"), printed("short")], np.uint64))
    for size in (50, 1000, imatch.SLAB):
        got = imatch.distinct_terms(texts, size=size)
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
        some = imatch.distinct_terms(texts, band, size)
        assert list(zip(some[0].tolist(), some[1].tolist(), strict=True)) == [x for x in want if x[1] in set(band.tolist())]


def test_columns_named_like_inner_ones(spark):
    rows = rows_of(40)
    inner = "id long, part long, place string, edited string, following long, fingerprint string, print long, docs long"
    df = spark.createDataFrame([(*r, 1, 2, "p", "e", 3, "f", 4, 5) for r in rows], f"doc_id long, text string, {inner}")
    assert found(imatch.compare(df)) == expected(rows)


def test_a_lexicon_over_its_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_TERMS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        imatch.compare(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
