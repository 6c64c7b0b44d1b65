"""Hashed text vectors and the projection against numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.operators import vectors


def test_text_vectors_against_plain_counts(spark):
    texts = ["River river bank", "bank of the RIVER, bank", "", None, "été 42 x_y 漢字", "!!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, chunk string").repartition(3)
    out = {r.id: r.embedding for r in vectors.text_vectors(df, "chunk", 16).collect()}
    words = [["river", "river", "bank"], ["bank", "of", "the", "river", "bank"], [], [], ["été", "42", "x_y", "漢字"], []]

    def place(w):
        h = hashlib.md5(w.encode()).hexdigest()
        return int(h[:7], 16) % 16, 1 if int(h[7], 16) % 2 == 0 else -1

    df_of = [sum(any(place(w)[0] == b for w in ws) for ws in words) for b in range(16)]
    for k, ws in enumerate(words):
        v = np.zeros(16)
        for w in ws:
            v[place(w)[0]] += place(w)[1]
        v *= [math.log(7 / (n + 1)) for n in df_of]
        want = v / np.sqrt(v @ v) if v.any() else v
        assert np.allclose(out[k], want)
    assert vectors.text_vectors(df.limit(0), "chunk", 16).count() == 0


def test_projection_is_that_of_the_leading_directions(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1]) @ np.linalg.qr(draw.normal(size=(6, 6)))[0] + 3
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(999, None)], "id int, embedding array<double>").repartition(5)
    found = vectors.covariance(df, "embedding")
    assert np.allclose(found, np.cov(x.T, bias=True))
    values, basis = np.linalg.eigh(found)
    for direction, true in zip(vectors.components(found), basis.T[::-1], strict=False):
        assert abs(direction @ true) > 1 - 1e-9
    places, others = vectors.projected(df, df.withColumnRenamed("embedding", "centroid"))
    a, b = vectors.components(found)
    got = {r.id: (r.umap_1, r.umap_2) for r in places.collect()}
    assert all(np.allclose(got[k], (v @ a, v @ b)) for k, v in enumerate(x)) and got[999] == (None, None)
    assert got == {r.id: (r.umap_1, r.umap_2) for r in others.collect()}
    empty, _ = vectors.projected(df.filter(F.lit(False)), df.withColumnRenamed("embedding", "centroid"))
    assert empty.count() == 0


def test_words_are_looked_at_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(vectors, "TOGETHER", 3)
    rows = [["a", "b"], [], ["c"], ["d", "a", "e", "f"], [], ["b"]]
    parts = list(vectors._placed(pa.array(rows, pa.list_(pa.string())), 16))
    assert [(lo, hi) for lo, hi, *_ in parts] == [(0, 3), (3, 4), (4, 6)]
    got = [(lo + r, p, s) for lo, _, row, place, sign in parts for r, p, s in zip(row, place, sign, strict=True)]
    assert got == [(k, *vectors.hashed(w, 16)) for k, words in enumerate(rows) for w in words]
