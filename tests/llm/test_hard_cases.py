"""Texts built against polynomial prints, long texts of one kind, bounded memories, hot keys, clashing columns."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from parlance.llm import anchors, audio, jaccard, quality, recompression, rows, secrets, suffix_dedup, textnum, tokens, wfst
from tests.llm.test_dedup import expected_bytes, expected_words
from tests.llm.test_jaccard import expected
from tests.llm.test_texts import base_spans


def morse(n: int, one: str = "a", two: str = "b") -> tuple[str, str]:
    """Two texts of 2**n letters, opposite at every place, whose polynomials are equal modulo a power of two at every odd base."""
    x, y = one, two
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_prints_tell_structured_texts_apart():
    for n in (10, 11, 13):
        for text in (morse(n), morse(n - 1, "ab", "ba")):
            data = [np.frombuffer(t.encode(), np.uint8) for t in text]
            for roller in (textnum.BYTES, textnum.BYTES2):
                one, two = (int(textnum.word_prints(d, np.array([0]), np.array([len(d)]), roller)[0]) for d in data)
                assert one != two and one >> 32 != two >> 32 and one & 0xFFFFFFFF != two & 0xFFFFFFFF


def test_spans_and_grams_are_the_polynomials():
    data = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8)
    roller = textnum.Roller(12345, 6789)
    sums = roller.prefix(data)
    start = np.array([0, 5, 32760, 65530, 99_000])
    got = roller.spans(sums, start, start + 40)
    for s, g in zip(start.tolist(), got.tolist(), strict=True):
        want = [sum(int(c) * pow(b, j, 2**31 - 1) for j, c in enumerate(data[s : s + 40])) % (2**31 - 1) for b in (12345, 6789)]
        assert g == want[0] << 32 | want[1]
    assert (roller.grams(sums, 40)[start] == got).all()


@pytest.fixture(scope="module")
def built():
    """Rows of words and lines that modulo-2**64 prints take for each other."""
    out = []
    for n in (10, 11):
        x, y = morse(n)
        out += [" ".join(x + str(k) for k in range(25)), " ".join(y + str(k) for k in range(25)), f"{x}\n{y}\n{x} {y} {x}\n" * 3, x + y, y + x]
    return list(enumerate(out))


def test_structured_texts_in_dedup_and_join(spark, built):
    df = spark.createDataFrame(built, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.dedup(df).collect()} == expected_words(built, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()} == expected_bytes(built, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == sorted(expected(built))
    lines = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality.score(df, None).collect()}
    assert lines[2] == lines[7] == (6, 15) and lines[0] == lines[1] == (0, 0)


def test_tokens_of_long_texts_without_a_stable_boundary():
    counter = tokens.PieceCounter(tokens.model_path())
    for text in ("a" * 600_000, "ab" * 150_000 + " end"):
        began = time.perf_counter()
        assert counter.count(text) == len(counter.model.encode(text))
        assert time.perf_counter() - began < 30


def test_secrets_of_a_long_text(spark):
    rng = random.Random(7)
    text = " ".join(rng.choice(["%032x" % rng.getrandbits(128), "password=%08x" % rng.getrandbits(32), "é"]) for _ in range(6000))
    extra = [(k, t, "found", 1, 2) for k, t in enumerate([text, None, "", "x" * 50_000, text[:2000], text[:2000]])]
    df = spark.createDataFrame(extra, "doc_id long, text string, found string, __text int, s int")
    out = secrets.scan(df).withColumn("masked", secrets.redacted()).collect()
    for r in out:
        t, names = extra[r.doc_id][1] or "", ("assign", "access", "hex", "random")
        assert {f"{names[k]}:{a}:{b}" for a, k, b in base_spans(t)} <= set(r.spans.split(","))
        plain, at = [], 0
        for s, _, e in sorted((x.s, x.k, x.e) for x in r.found):
            if s >= at:
                plain += [t[at:s], "[SECRET]"]
            at = max(at, e)
        assert r.masked == "".join(plain) + t[at:]
    assert secrets.scan(df.limit(0)).count() == 0


def test_random_spans_keep_off_the_fixed_ones(spark):
    rng = np.random.default_rng(3)
    spans = lambda n: sorted({(int(a), int(a) + int(b)) for a, b in zip(rng.integers(0, 30000, n), rng.integers(1, 40, n), strict=True)})
    kind = "array<struct<s:int,e:int>>"
    table = [(spans(n), spans(m)) for n, m in ((0, 3), (5, 0), (300, 700), (900, 900), (1, 600))]
    df = spark.createDataFrame(table, f"b {kind}, f {kind}").selectExpr("transform(b, x -> struct(x.s as s, 0 as k, x.e as e)) as b", "f")
    got = df.selectExpr(f"{secrets._apart('b', 'f')} as kept").collect()
    for (b, f), r in zip(table, got, strict=True):
        assert [(x.s, x.e) for x in r.kept] == [(s, e) for s, e in f if not any(p < e and s < q for p, q in b)]


def test_transducer_memory_is_bounded():
    machine = wfst.Transducer(tokens.model_path(), remembered=200_000)
    rng = random.Random(5)
    for _ in range(300):
        machine.encode(" ".join("".join(rng.choice("abcdefghijkl") for _ in range(9)) for _ in range(60)))
        assert machine.paths.held <= 210_000 and len(machine.stands) <= machine.most_stands + 1
    machine.encode("z" * 5000)
    assert max(map(len, machine.paths)) <= wfst.LONGEST


def test_transducer_refuses_other_models(tmp_path):
    model = open(tokens.model_path(), "rb").read()
    kinds = {3: 2}

    def changed(field: int, inner: bytes) -> str:
        path = tmp_path / f"{field}{len(inner)}{inner[0]}.model"
        path.write_bytes(model + bytes([field << 3 | 2, len(inner)]) + inner)  # the last message of a field counts here
        return str(path)

    assert kinds and wfst.Normaliser(tokens.model_path())("a b") == "▁a▁b"
    for field, inner in ((wfst.TRAINER, bytes([3 << 3, 1])), (wfst.NORMALISER, bytes([4 << 3, 1])), (wfst.NORMALISER, bytes([2 << 3 | 2, 1, 7, 4 << 3, 0]))):
        with pytest.raises(ValueError):
            wfst.Normaliser(changed(field, inner))


def test_hot_anchors_pass_the_sort_untouched():
    h = np.array([5, 5, 5, 9, 5], np.int64)
    s = np.array([1, 1, 2, 1, 1], np.int64)
    key, first, shape = np.array([3, 2, 3, 1, 2]), np.array([0, 4, 8, 0, 1]), np.full(5, 300)
    h2, _, _, _, shape2 = anchors.told(h, s, key, first, shape)
    assert shape2.tolist() == [-300, -300, 300, 300, 300] and h2[2:].tolist() == [5, 9, 5] and len(set(h2[:2].tolist()) | {5}) == 3


def test_attached_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(rows, "HOT_ROWS", 10)
    many = spark.createDataFrame([(k, "hot" if k < 60 else f"k{k}") for k in range(100)], "key long, name string")
    named = spark.createDataFrame([("hot", 1), ("k60", 2), ("k61", 3)], "name string, number int")
    want = {k: 1 if k < 60 else {60: 2, 61: 3}.get(k) for k in range(100)}
    assert {r.key: r.number for r in rows.attached(many, named, ["name"], "left").collect()} == want
    assert {r.key: r.number for r in rows.attached(many, named, ["name"]).collect()} == {k: v for k, v in want.items() if v}


def test_join_names_repeated_and_null_ids(spark):
    text = " ".join(f"t{k}" for k in range(60))
    df = spark.createDataFrame([(7, text, 1), (7, text, 2), (None, text, 3), (3, "other words of its own", 4), (None, "", 5)], "doc_id long, text string, key int")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df).collect()) == sorted([("7", 56, "7"), ("7", 56, "7"), ("None", 56, "7"), ("3", 1, "3"), ("None", 0, "None")])


def test_quality_of_repeated_labels_and_long_texts(spark):
    docs = spark.createDataFrame([(k % 20, f"{'good' if k % 2 else 'bad'} {k} words " * 40, 1) for k in range(60)] + [(90, "word " * 300_000, 1)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(k % 20, k % 2) for k in range(40)] + [(90, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels) is not None and quality.train(docs, labels, max_bytes=10_000) is not None
    assert quality.train(docs, labels, max_bytes=10) is None
    assert quality.rules(docs, labels).filter("doc_id = 90").first().n_words == 300_000


def tune(rng, n: int, rate: int) -> np.ndarray:
    time_ = np.arange(rate // 8) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time_) for k in rng.integers(0, 24, n)])


def test_recordings_of_other_rates_align(spark):
    wide = lambda x: bytearray(audio.wav((128 + 90 * x).astype(np.uint8), 8000))
    slow = tune(np.random.default_rng(4), 60, audio.RATE)
    fast = tune(np.random.default_rng(4), 60, 8000)
    other = tune(np.random.default_rng(5), 60, 8000)
    rows_ = [(100, bytearray(audio.wav((128 + 90 * slow).astype(np.uint8))), "x"), (1, wide(fast), "y"), (2, wide(other), "z"), (3, bytearray(b"RIFF....WAVEfmt "), None)]
    out = audio.search(spark.createDataFrame(rows_, "doc_id long, audio binary, items string"), "doc_id % 100 = 0").collect()
    assert {(r.doc_id, r.query_id) for r in out} == {(100, None), (1, 100), (2, None), (3, None)}
    assert [abs(r.offset) <= 1 for r in out if r.doc_id == 1] == [True]
    empty = spark.createDataFrame([], "doc_id long, audio binary")
    assert audio.search(empty, "doc_id % 100 = 0").count() == 0


def test_search_by_blocks_gives_the_same(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "five"]) + str(rng.randrange(9)) for _ in range(150)) for _ in range(6)]
    edited = [t.replace("one1", "six") for t in texts]
    media = audio.recordings(spark.createDataFrame([(100 * k, t) for k, t in enumerate(texts)] + [(100 * k + 1, t) for k, t in enumerate(edited)] + [(5, texts[0])] * 2, "doc_id long, text string"))
    prints = audio.stash(audio.fingerprints(media, "doc_id", is_query="id % 100 = 0").selectExpr("*", "monotonically_increasing_id() as row"), "prints")
    whole, split = (sorted(map(str, audio.align(prints, n).collect())) for n in (1 << 20, 100))
    assert whole == split and sum("query_id=0," in r for r in whole) >= 3
    # the frames of many recordings together are those of each
    sounds = [np.sin(np.arange(n) * 0.7).astype(np.float32) for n in (0, 100, 5000, 200_000, 300)]
    for one, all_ in zip(map(audio.fingerprint, sounds), audio.fingerprint_all(sounds), strict=True):
        assert len(one) == len(all_) and (one == all_).mean() > 0.99 if len(one) else not len(all_)
