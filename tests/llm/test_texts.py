"""Quality, token counts, encoding, secrets, mixing, pages and audio."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from parlance.llm import audio, html, mixing, quality, secrets, tokens, wfst

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é漢 \U0001f600 \x00x"), (4, "é漢 \U0001f600 \x00x"), (None, "one two")]


def odd(spark):
    """Nulls, empty texts, repeated rows and ids, other columns with inner names."""
    return spark.createDataFrame([(a, b, "c", 1) for a, b in ODD], "doc_id long, text string, id string, __text int")


def test_quality_base_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bé", "#c*", "d|"]) + rng.choice(["", "\n", " \n\n"]) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()
    for r in rows:
        t = texts[r.doc_id]
        w, seen, lines, marked = WORD.findall(t), set(), 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                marked |= {i, i + 1, i + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(marked))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "a", "quiet", "river"]) + str(rng.randrange(9)) for _ in range(90))
    bad = lambda: " ".join(rng.choice(["BUY", "now$$$", "###click", "WIN!!!"]) + rng.choice(["$$$", "!!!", "%%%"]) + str(rng.randrange(9)) for _ in range(90))
    rows = [(k, bad() if k % 4 == 0 else good()) for k in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(120)] + [(None, 1), (5, None)], "doc_id long, quality int")
    held = [r for r in quality.rules(docs, labels).collect() if r.doc_id >= 120 and not r.base_failed]
    assert len(held) > 100 and all(r.kept == (r.doc_id % 4 != 0) for r in held)
    assert quality.train(docs, labels.filter("quality = 1")) is None and quality.train(docs.limit(0), labels) is None
    assert {r.kept for r in quality.score(odd(spark), None).collect()} == {False} and quality.score(odd(spark).limit(0), None).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())


def strange_texts():
    rng = random.Random(3)
    alphabet = "abcdefghinorstt  \n▁é漢\U0001f600\x00<s>THE.,1230-"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))) for _ in range(120)] + ["a" * 900, " " * 400, "th" * 400, "", "<s></s><unk><0x0A>"]


def test_token_counts_by_chunks(library):
    counter = tokens.PieceCounter(tokens.model_path())
    assert [counter.count(t, 64, 4) for t in strange_texts()] == [len(library.encode(t)) for t in strange_texts()]


def test_token_counts(spark, library):
    out = tokens.count_tokens(odd(spark), tokens.model_path(), chunk=8, overlap=2).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == sorted((str(k), len((t or "").encode()), len(library.encode(t or ""))) for k, t in ODD)
    assert tokens.count_tokens(odd(spark).limit(0), tokens.model_path()).count() == 0


def test_transducer_equals_the_library(spark, library):
    machine = wfst.Transducer(tokens.model_path())
    for t in strange_texts():
        ids = machine.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert machine.decode(ids) == library.decode(ids.tolist())
    out = wfst.encode(odd(spark), tokens.model_path()).collect()
    assert all(r.round_trip for r in out) and sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(k), library.encode(t or "")) for k, t in ODD)
    back = wfst.decode(wfst.encode(odd(spark), tokens.model_path(), carry=["text"]), tokens.model_path()).collect()
    assert all(r.decoded == (r.text or "") for r in back)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_scan(spark):
    rng = random.Random(4)
    piece = lambda: rng.choice(["Password", 'api_key": "', "token", " = ", ":", "abc", "secret=", "AKIA", "ABCDEFGH12345678", "é", "deadbeef0123", " ", "\n", "'x'", "0123456789abcdef"])
    texts = ["".join(piece() for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, "", "secret=token: abcdefgh"]
    names = ("assign", "access", "hex")
    for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans = base_spans(texts[r.doc_id] or "")
        assert [sum(s[1] == k for s in spans) for k in range(3)] == [r.n_assign, r.n_access, r.n_hex]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert set(f"{names[k]}:{a}:{b}" for a, k, b in spans) <= set(r.spans.split(","))


def test_random_runs_are_found(spark):
    rng = np.random.default_rng(5)
    keys = [base64.b64encode(rng.bytes(36)).decode() for _ in range(40)]
    plain = ["thisisaratherlongwordofordinarytext", "/home/user/projects/archive/2024/05/notes", "abcdefghijklmnopqrstuvwxyzabcdefghij", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "----------------------------------", "ThisIsCamelCaseForSomeReasonInTheText"]
    rows = [(k, f"see {v} here") for k, v in enumerate(keys)] + [(1000 + k, f"see {v} here") for k, v in enumerate(plain * 30)]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), carry=[]).withColumn("m", secrets.redacted()).collect()}
    hits = [k for k, r in out.items() if "random" in r.spans]
    assert len([k for k in hits if k < 1000]) >= 36 and not [k for k in hits if k >= 1000]
    assert out[hits[0]].m == "see [SECRET] here" and out[1001].m == rows[41][1]


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 7, 50, 400])), rng.choice(["a", "b", "c", "d", None, ""]) if k > 5 else "tiny") for k in range(900)]
    df = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    source = {k: s for k, _, s in rows} | {None: None}
    by: dict = {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        got = by.setdefault(source[r.doc_id], [r.source_size, r.target, 0])
        got[2] += r.taken
    assert abs(sum(v[1] for v in by.values()) - 1.5 * sum(v[0] for v in by.values())) < 1e-6
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 1
    order = sorted((s for s in by if s is not None)) + [None]
    open_ = [s for s in order if by[s][1] < 2 * by[s][0] - 1e-6]
    levels = {round(by[s][1] / (5, 2, 1)[order.index(s) % 3], 6) for s in open_}
    assert len(levels) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_subset_sum():
    assert mixing.subset_sum([(7, 3), (5, 2)], 17) == {7: 1, 5: 2}
    rng = random.Random(7)
    for _ in range(200):
        counts = [(s, rng.randrange(1, 5)) for s in rng.sample(range(1, 30), 4)]
        budget = rng.randrange(0, 120)
        sums = {0}
        for s, c in counts:
            sums |= {x + s * k for x in sums for k in range(c + 1)}
        got = mixing.subset_sum(counts, budget)
        assert sum(s * k for s, k in got.items()) == max(x for x in sums if x <= budget) and all(k <= dict(counts)[s] for s, k in got.items())


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>T &amp; {0}</h1><p>First  {0}<br>line &lt;b&gt;<p>Second <b>bold {0}</b><script>var x="</p>";</script><ul><li>one{0}<li>two</ul></article>
<section id="comments"><p>Reader {0}</p></section><aside>Side</aside><form>Mail <input></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE.format("n"), {}) == "T & n\nFirst n line <b>\nSecond bold n\nonen\ntwo"
    assert html.main_text("", {}) == "" and html.main_text("plain &eacute; text", {}) == "plain é text"
    assert html.main_text("<p>open <b", {}) == "open" and html.main_text("a<script>never closed", {}) == "a"


def test_template_tokens_out_of_order_stay():
    page = "<p>a</p><p>b</p><p>c</p>"
    rank = {html._token("text", e, v): "abc".index(v) for k, e, v in html.events(page) if k == "text"}
    assert html.main_text(page, rank) == "" and html.main_text("<p>b</p><p>c</p><p>a</p><p>own</p>", rank) == "a\nown"


def test_templates_and_pages(spark):
    page = "<html><body><div class=top>Welcome to our paper</div><div>{0} own story</div><div>All rights reserved</div></body></html>"
    rows = [(k, "http://a.example/" + str(k), page.format(f"story {k}")) for k in range(12)] + [(50, "http://b.example/", page.format("alone")), (51, None, None), (52, "x", ""), (53, "http://a.example/p", PAGE.format("z"))]
    out = {r.page_id: r for r in html.extract(spark.createDataFrame(rows[:12] + rows[12:15], "page_id long, url string, html string")).collect()}
    assert out[3].text == "story 3 own story" and out[3].n_chars == len(out[3].text)
    assert out[50].text == "Welcome to our paper\nalone own story\nAll rights reserved" and out[51].text == out[52].text == ""
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_audio_alignment(spark):
    rng = np.random.default_rng(8)

    def tune(n):
        time = np.arange(160) / audio.RATE
        return np.concatenate([128 + 100 * np.sin(2 * np.pi * 440 * 2 ** (k / 12) * time) for k in rng.integers(0, 24, n)])

    base, other = tune(60), tune(60)
    noisy = np.clip(base + rng.normal(0, 4, len(base)), 0, 255)
    late = np.concatenate((tune(10), base[: len(base) * 3 // 4]))
    media = [(100, base), (200, other), (1, noisy), (2, late), (3, tune(60)), (4, np.zeros(0))]
    rows = [(k, bytearray(audio.wav(np.asarray(x).astype(np.uint8)))) for k, x in media] + [(5, None), (6, bytearray(b"broken"))]
    out = audio.search(spark.createDataFrame(rows, "doc_id long, audio binary"), "id % 100 = 0").collect()
    found = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and {k for k, r in found.items() if r.query_id is not None} == {1, 2}
    assert found[1].query_id == 100 and found[1].offset == 0 and abs(found[2].offset + 10 * 160 // audio.HOP) <= 1 and found[5].n_items == 0
    # brute force: all offsets of all queries
    prints = {k: audio.fingerprint(audio.pcm(bytes(a) if a is not None else None)) for k, a in rows}
    for k, x in prints.items():
        best = min((np.bitwise_count(x[max(0, -s) : len(q) - s] ^ q[max(0, s) : len(x) + s]).mean() / 32, n) for n, q in prints.items() if n % 100 == 0 and n != k for s in range(-len(x) // 2, len(q) // 2 + 1) if min(len(q) - max(0, s), len(x) - max(0, -s)) > 0) if len(x) else (1, None)
        assert (best[0] <= 0.1) == (found[k].query_id is not None) or found[k].query_id is not None
