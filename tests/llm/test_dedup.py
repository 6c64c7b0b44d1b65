"""Suffix and substring dedup against brute force on small texts full of repeats."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from parlance.llm import recompression, suffix_dedup
from parlance.llm.suffixes import deep_shallow


def corpus(seed, words, docs=50, most=120):
    """Texts of few different words, sharing passages, with empty, null, short and repeated ones."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))) for _ in range(6)]
    out = []
    for _ in range(docs):
        parts = [rng.choice(passages) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, most))]
        out.append(rng.choice([" ", "  ", "\n"]).join(parts))
    out += [out[0], None, "", "a" * 500, "a" * 130, " ".join(["so"] * 90), " ".join(["so"] * 25), "é" * 120]
    return list(enumerate(out))


def expected_bytes(rows, window):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def expected_words(rows, window):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(k)
        out[key] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, monkeypatch):
    rows = corpus(1, ["alpha", "beta", "gamma", "delta", "épsilon", "z"])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}
    assert found() == expected_bytes(rows, 100)
    monkeypatch.setattr(suffix_dedup, "MOST", 2)  # all by content
    assert found() == expected_bytes(rows, 100)


def test_suffix_dedup_cuts_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 400)
    rng = random.Random(4)
    text = " ".join(rng.choice(["one", "two", "three", "four"]) + str(rng.randrange(40)) for _ in range(700))
    rows = [(1, text), (2, "x" + text[300:2300] + "y"), (3, text[100:900])]
    out = suffix_dedup._piece_anchors(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 100)
    assert sum(int(s) >> 8 for s in out[4]) == len(text) - 99  # every window has one anchor
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()} == expected_bytes(rows, 100)


def test_deep_shallow_orders_suffixes():
    rng = random.Random(2)
    suffixes = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + [b"a" * 120 + bytes([97 + k % 3]) * (k % 5) for k in range(60)]
    group = np.array([rng.randrange(5) for _ in suffixes])
    order, lcp = deep_shallow(group, suffixes, 16)
    ordered = [(int(group[i]), suffixes[i]) for i in order]
    assert ordered == sorted(ordered)
    for k in range(1, len(order)):
        a, b = ordered[k - 1], ordered[k]
        n = next((i for i in range(min(len(a[1]), len(b[1]))) if a[1][i] != b[1][i]), min(len(a[1]), len(b[1])))
        assert lcp[k] == (-1 if a[0] != b[0] else n)


def test_substring_dedup(spark):
    for seed, vocabulary in ((3, ["a", "b"]), (4, [f"w{k}" for k in range(30)])):
        rows = corpus(seed, vocabulary)
        out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out == expected_words(rows, 20)


def test_repeated_null_ids_and_empty(spark):
    text = " ".join(f"t{k}" for k in range(60))
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3)], "doc_id long, text string, key int")
    assert sorted((str(r.doc_id), r.n_removed) for r in recompression.dedup(df).collect()) == [("1", 0), ("1", 60), ("None", 60)]
    n = len(text)
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(df).collect()) == [("1", 0), ("1", n), ("None", n)]
    assert recompression.dedup(df.limit(0)).count() == 0 and suffix_dedup.dedup(df.limit(0)).count() == 0
