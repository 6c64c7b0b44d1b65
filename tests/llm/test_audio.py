"""Recordings that are short or steady, and recall against all offsets."""

from __future__ import annotations

import numpy as np
import pytest

from parlance.llm import audio


def test_short_and_steady_recordings_meet_their_query(spark):
    short = [" ".join(f"w{n}x{k}" for k in range(n)) for n in range(10, 28)]
    steady = [("a " * 300, "a " * 300), ("b " * 200, "b " * 260)]
    pairs = [(t, t) for t in short] + steady
    rows = [(100 * (k + 1) + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)] + [(7, None), (8, ""), (9, "other short text of no copy")]
    rows += [(10000, "")]
    found = audio.search(audio.recordings(spark.createDataFrame(rows, "doc_id long, text string")), "id % 100 = 0").collect()
    met = {(r.doc_id, r.query_id) for r in found if r.query_id is not None}
    assert {(100 * (k + 1) + 1, 100 * (k + 1)) for k in range(len(pairs))} <= met
    assert not [m for m in met if m[0] in (7, 8, 9, 10000)]
    assert {r.bit_error for r in found if r.doc_id < 1900 and r.query_id == r.doc_id - 1} == {0.0}


def test_few_integers_meet_at_every_place():
    rng = np.random.default_rng(9)
    for _ in range(200):
        long, n = rng.integers(0, 1 << 32, 40, np.uint32), int(rng.integers(1, 4))
        at = int(rng.integers(0, 41 - n))
        few = long[at : at + n] ^ np.uint32(1 << int(rng.integers(0, 32)))
        for x, y, shift in ((few, long, at), (long, few, -at)):
            assert audio.Block([100], [y], [None]).matches(1, x) == [(100, shift, n, round(1 / 32, 6))]


def plain(block, own, x, same):
    """Offsets by votes of runs, and their stretches, one after the other."""
    equal, out = block.whole.get(same), {}
    if equal is not None and block.ids[equal] != own:
        out[equal] = (int(block.ids[equal]), 0, len(x), 0.0)
    split = lambda v: [(a, b) for a in range(len(v)) if not a or v[a] != v[a - 1] for b in [next((j for j in range(a, len(v)) if v[j] != v[a]), len(v)) - 1]]
    for q, phases in enumerate(block.items):
        votes = {}
        if q in out or block.ids[q] == own:
            continue
        for r, y in enumerate(phases):
            for (a, b), (c, d) in ((s, t) for s in split(x) for t in split(y) if x[s[0]] == y[t[0]]):
                for shift in {c - a, d - b}:
                    votes[4 * shift + r] = votes.get(4 * shift + r, 0) + min(b - a + 1, d - c + 1, audio.LEAST_VOTES)
        for offset in sorted(votes):
            shift, y = offset // 4, phases[offset % 4]
            first, last, least = max(0, -shift), min(len(x), len(y) - shift), max(block.least, -(-min(len(x), len(y)) // 2))
            if votes[offset] < min(audio.LEAST_VOTES, len(x), *map(len, phases)) or last - first < least:
                continue
            errors = []
            for at in range(first, last - least + 1):
                here, there = x[at : at + least], y[at + shift : at + shift + least]
                wrong = int(np.bitwise_count(here ^ there).sum())
                new = min(sum(i == first or v[i + s] != v[i + s - 1] for i in range(at, at + least)) for v, s in ((x, 0), (y, shift)))
                errors += [wrong / (32 * least)] if not wrong or new >= audio.LEAST_CHANGED * least else []
            if errors and min(errors) <= audio.MOST_ERROR and (q not in out or (out[q][3], -out[q][2]) > (round(min(errors), 6), first - last)):
                out[q] = (int(block.ids[q]), offset, last - first, round(min(errors), 6))
    return sorted(out.values())


def sounds_with_common_passages(rng, n):
    """Integers of recordings that share passages, repeat, are copies with errors of others, steady, or too short."""
    passages, out = [rng.integers(0, 1 << 32, 12, np.uint32) for _ in range(3)], []
    for k in range(n):
        x = np.concatenate([passages[j] if j < 3 else rng.integers(0, 1 << 32, int(rng.integers(1, 15)), np.uint32) for j in rng.integers(0, 6, int(rng.integers(0, 6)))] or [np.zeros(0, np.uint32)])
        if k % 3 == 0 and out:
            x = out[int(rng.integers(0, len(out)))][int(rng.integers(0, 5)) :].copy()
            x[rng.random(len(x)) < 0.3] ^= np.uint32(7)
        if k % 7 == 0 and len(x):
            x = np.repeat(x[:10], rng.integers(1, 6, len(x[:10])))
        out.append(x.astype(np.uint32))
    return out


@pytest.mark.parametrize("bounds", [{}, {"HITS": 20, "PLACES": 16}])
def test_recordings_looked_up_together_match_as_one_by_one(monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(audio, name, value)
    rng = np.random.default_rng(11)
    asked = [[x[i:] for i in range(4)] if len(x) > 4 else [x] * 4 for x in sounds_with_common_passages(rng, 30)]
    same = [audio._whole(p[0], p[0]) for p in asked]
    block = audio.Block([100 * k for k in range(30)], asked, same, audio.LEAST_COMPARED)
    worse = [np.where(rng.random(len(p[0])) < 0.3, p[0] ^ np.uint32(7), p[0])[k % 3 :] for k, p in enumerate(asked)]
    items = sounds_with_common_passages(rng, 40) + worse + [asked[5][0], asked[5][0], asked[8][0], np.zeros(0, np.uint32)]
    owns = [*range(1, 71), 500, 7, None, 3]
    marks = [audio._whole(x, x) for x in items]
    found = block.all_matches(owns, items, marks)
    assert [sorted(f) for f in found] == [plain(block, own, x, mark) for own, x, mark in zip(owns, items, marks, strict=True)]
    assert sum(map(len, found)) > 30


def test_a_common_passage_takes_no_comparison_for_each_query(monkeypatch):
    rng = np.random.default_rng(12)
    passage = rng.integers(0, 1 << 32, 6, np.uint32)
    sounds = [np.concatenate((rng.integers(0, 1 << 32, 30, np.uint32), passage, rng.integers(0, 1 << 32, 30, np.uint32))) for _ in range(301)]
    block = audio.Block([100 * k for k in range(300)], sounds[:300], [None] * 300, audio.LEAST_COMPARED)
    calls, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(len(x)) or count(x))
    assert block.matches(1, sounds[300]) == [] and len(calls) < 30
    # as many places as all candidates have, of which whole pairs of integers are compared
    assert 0 < sum(calls) <= 300 * len(sounds[0])
